"""Evidence-table analytics on Spark: DataFrame operators for recognised text, geometry, captures and audits."""
