"""Token counts by compiled finite-state transducers (see bpe.py)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import compiled, unpacked
from .common import each_slice


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text, exactly as the library has them for the byte-level BPE file at path.

    Returns id_col, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit). Special strings inside a text count as
    one token, as by the library's default; no other special tokens are added. A null text counts as empty: 0 bytes, 0
    tokens. A null id stays null; repeated rows each get a row; other columns of df are not read, whatever their names.

    One narrow pass without a shuffle: a task's memory is bounded by a run of 2 MB of text (or one longer text) and by
    the transducer, whose states and remembered pre-tokens are bounded.
    """
    sent = compiled(df.sparkSession, path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        machine = unpacked(sent, path)
        for part, buf, offs in each_slice(batches, "t", 2 << 20):
            n = machine.count_texts(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(offs[1:] - offs[:-1], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
