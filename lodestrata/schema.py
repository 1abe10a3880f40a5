"""Column layouts of the logs. A log row is one version; nothing is updated in place."""

from pyspark.sql import types as T

KEY, EPOCH, SEQ, TOMB = "k", "epoch", "seq", "tomb"


def kv_log(columns) -> T.StructType:
    """Versions of a keyed table: key, epoch, sequence within the epoch, deletion mark, then the value columns.

    columns: names (strings, the parity mode) or StructFields (typed columns).
    """
    values = [c if isinstance(c, T.StructField) else T.StructField(c, T.StringType()) for c in columns]
    return T.StructType([T.StructField(KEY, T.StringType(), False), T.StructField(EPOCH, T.LongType(), False), T.StructField(SEQ, T.LongType(), False), T.StructField(TOMB, T.BooleanType(), False), *values])


EDGE_LOG = "label int, src bigint, dst bigint, prop double, epoch bigint, seq bigint, tomb boolean"
VERTEX_LOG = "label int, id bigint, property string, epoch bigint, seq bigint"
VERTEX_DELETES = "label int, id bigint, del_epoch bigint"
VERTEX_LABELS = "id int, name string"
EDGE_LABELS = "id int, name string, src_id int, dst_id int"
