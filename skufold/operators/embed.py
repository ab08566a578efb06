"""Identity -> vector.

Encoders:
  ``precomputed`` join vectors supplied by the caller on the SKU id (S7); every
                  row stays, ``embedding_status`` says whether it has a vector
  ``hashed``      Spark ML: RegexTokenizer -> HashingTF -> Normalizer (offline,
                  JVM-side; nothing is fitted, so a brand gets the same vectors
                  whatever else is in the run)
  ``tfidf``       hashed terms weighed by their frequency in the brand, from
                  ``tfidf.FrequencyStore`` (``frequencies``) or the rows given
  callable        a factory, called once per Python worker, that returns the
                  function from a batch of texts to vectors
                  (``predict_batch_udf``, Arrow batches of 32 rows)
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import clean_identity
from . import tfidf

KEY = "brandSKUId"


def read_embeddings(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Precomputed vectors as (brandSKUId, embedding array<float>)."""
    return vectors.select(F.col(key).alias(KEY), F.col(vec).alias("embedding"))


def embed(df: DataFrame, encoder="hashed", identity: str = "core_identity", num_features: int = 384,
          vectors: DataFrame | None = None, frequencies: DataFrame | None = None, batch_size: int = 32) -> DataFrame:
    """Add ``embedding`` (array<double|float>) for each row's cleaned identity."""
    if encoder == "tfidf":
        return tfidf.vectors(df, identity, frequencies, num_features)
    df = df.withColumn("_ident", clean_identity(F.col(identity)))
    if encoder == "precomputed":
        if vectors is None:
            raise ValueError("encoder='precomputed' needs a vectors DataFrame")
        out = df.join(vectors.select(KEY, "embedding"), KEY, "left").drop("_ident")
        return out.withColumn("embedding_status", F.when(F.col("embedding").isNull(), "missing").otherwise("ok"))
    if encoder == "hashed":
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
        from pyspark.ml.functions import vector_to_array
        pipe = Pipeline(stages=[
            RegexTokenizer(inputCol="_ident", outputCol="_tok", pattern="[^\\p{L}\\p{N}_]+"),
            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features),
            Normalizer(inputCol="_tf", outputCol="_vec", p=2.0)])
        model = pipe.fit(df.select("_ident"))
        out = model.transform(df)
        return (out.withColumn("embedding", vector_to_array("_vec"))
                .drop("_ident", "_tok", "_tf", "_vec"))
    if callable(encoder):
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, FloatType

        make: Callable = encoder
        udf = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch_size,
                                input_tensor_shapes=None)
        return df.withColumn("embedding", udf(F.col("_ident"))).drop("_ident")
    raise ValueError(f"unknown encoder {encoder!r}")
