"""The observation row and the fixed numbers of the method."""

from pyspark.sql import types as T

# They decide which results are right, so they are stated once, here.
RADIUS_DEG2 = 0.0000013888  # squared match radius in deg^2 (4.2425 arc seconds)
CELL_ORDER = 10  # level of the sky cell that rows are grouped by
FINE_ORDER = 13  # level whose neighbours decide which rows lie on a cell border
MAX_MISSES = 7  # consecutive missed epochs after which a bright object is dropped
MAG_LIMIT = 18.0  # objects fainter than this are never dropped
INVALID_MAG = 99.0  # value written by the catalogue for "no measurement"
NO_NEIGHBOURS = "-"  # text form of an empty neighbour list

OBSERVATION = T.StructType(
    [
        T.StructField("epoch", T.IntegerType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("ra", T.DoubleType()),
        T.StructField("dec", T.DoubleType()),
        T.StructField("mag", T.DoubleType()),
        T.StructField("magerr", T.DoubleType()),
        T.StructField("cell", T.LongType()),
        T.StructField("border_cells", T.ArrayType(T.LongType())),
        T.StructField("obs_time", T.TimestampType()),
        T.StructField("match_state", T.StringType()),
        T.StructField("miss_streak", T.IntegerType()),
    ]
)
