"""Marketing measurement on Spark: governed metrics, reconciliation and decision signals as DataFrame plans."""
