"""Python functions that queries use by name; types are read from annotations, so these aren't postponed."""

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udf, udtf


@udf(T.LongType())
def twice_py(x):
    return 2 * x


@pandas_udf(T.StringType())
def loud_py(x: pd.Series) -> pd.Series:
    return x.str.upper()


@pandas_udf(T.LongType())
def most_py(x: pd.Series) -> int:
    return int(x.max())


@udtf(returnType=T.StructType().add("word", T.StringType()))
class CutPy:
    def eval(self, text: str, sign: str):
        for word in text.split(sign):
            yield (word,)
