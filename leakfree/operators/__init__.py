"""DataFrame operators: ordered scans, folds, features, models, metrics and log analytics."""
