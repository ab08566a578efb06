"""skufold: group catalog items into variants of one core product, on Spark.

Sub-packages:
  sources    readers (parquet catalog tables, CSV files, JDBC, batch outputs, vectors)
  functions  column-expression builders (label normalization, categories, facets,
             identity strings, phonetic codes, variant signatures)
  operators  DataFrame -> DataFrame steps (extract, embed, neighbours, clustering,
             results, batching, chart tables)
  sinks      writers
  plans      end-to-end flows composed from the above
  streaming  incremental upsert with Structured Streaming
"""

__version__ = "0.1.0"
