"""docquarry: operators."""
