"""seqloom: a PySpark analytics engine for aligned sequencing reads and the corpora kept beside them."""
