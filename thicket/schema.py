"""Schemas and reserved constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Special symbols of the word vocabulary, ids 0..23 in this order.
SPECIAL_SYMBOLS = [
    "<unk>", "<s>", "</s>", "[PAD]", "[CLS]", "[SEP]", "[MASK]", "<eod>", "<eop>",
    "[MASK_STRING]", "[MASK_NUMBER]", "[MASK_METHOD_NAME]", "[INDENT]", "[DEDENT]",
    "[CLS_1]", "[CLS_2]", "[CLS_3]", "[CLS_4]", "[CLS_5]", "[CLS_6]", "[CLS_7]", "[CLS_8]", "[CLS_9]", "[CLS_10]",
]
# Special symbols of the node-type and token-type vocabularies.
TYPE_SYMBOLS = ["<unk>", "</s>", "[CLS]"]

UNK, EOS, PAD, CLS, SEP, MASK = 0, 2, 3, 4, 5, 6
NUM_SUB_TOKENS = 5
NUM_LABEL_TOKENS = 6
MAX_TOKENS = 512
UNREACHABLE = 10_000
DISTANCE_LIMIT = 1_000
BIN_PADDING = 0
MAX_PATH_LENGTH = 8
MAX_PATH_WIDTH = 2

_POSITION = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("col", T.IntegerType())])
SPAN = T.StructType([T.StructField("start", _POSITION), T.StructField("end", _POSITION)])
TOKEN = T.StructType([T.StructField("sub_tokens", T.ArrayType(T.StringType())), T.StructField("token_type", T.StringType()), T.StructField("span", SPAN)])
RAW_SAMPLE = T.StructType([T.StructField("func_name", T.StringType()), T.StructField("docstring", T.StringType()), T.StructField("code", T.StringType())])
RAW_METHOD = T.StructType([T.StructField("name", T.StringType()), T.StructField("doc", T.StringType()), T.StructField("code", T.StringType())])
NODES = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("child_idx", T.IntegerType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("span", SPAN),
    ]
)
