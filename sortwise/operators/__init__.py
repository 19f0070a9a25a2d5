"""DataFrame -> DataFrame operators (classification, scopes, tokens, payloads,
duplicates, reports)."""
