"""Domain dataflows: from landed records to scores."""
