"""Functions that need Python: Arrow-batched UDFs where the JVM has no counterpart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as S

# The worker imports what these call, so that must not define UDFs itself.
from loomlex.functions.cleaning import article_slug, author_slug, clean_body, cut_chunks, decode_upload, slugify

#: Types as objects: a type in words would need a session when the module is imported.
CHUNK = S.StructType([S.StructField("text", S.StringType()), S.StructField("start", S.IntegerType()), S.StructField("end", S.IntegerType())])


@F.pandas_udf(S.StringType())
def clean_body_udf(body: pd.Series, title: pd.Series, abstract: pd.Series) -> pd.Series:
    """Body of an article without its front and back matter (SCL10)."""
    return pd.Series([clean_body(b, t, a) for b, t, a in zip(body, title, abstract)])


@F.pandas_udf(S.ArrayType(CHUNK))
def chunks_udf(text: pd.Series) -> pd.Series:
    """Chunks of at most 1200 characters with their offsets (SCL16)."""
    return pd.Series([[{"text": t, "start": a, "end": b} for t, a, b in cut_chunks(x)] for x in text])


@F.pandas_udf(S.StringType())
def decode_upload_udf(data: pd.Series) -> pd.Series:
    return data.map(decode_upload)


@F.pandas_udf(S.StringType())
def slug_udf(value: pd.Series) -> pd.Series:
    return value.map(slugify)


@F.pandas_udf(S.StringType())
def article_slug_udf(value: pd.Series) -> pd.Series:
    return value.map(article_slug)


@F.pandas_udf(S.StringType())
def author_slug_udf(value: pd.Series) -> pd.Series:
    return value.map(author_slug)
