"""DataFrame operators over arms, pairs and long-form sparse features (pair_id, feature, value)."""
