"""DataFrame operators: measuring, comparing, rule mining, scanning, selecting."""
