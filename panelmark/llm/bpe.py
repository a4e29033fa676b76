"""BPE encoding and decoding of a corpus, fragment by fragment (see ``tokens``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelmark.llm.common import id_and_text, slices, small_batches
from panelmark.llm.tokens import default_path, encoder


def encode_texts(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, ids array<int>, decoded string): the ids of each whole text and the text they decode to.

    Rows are independent: no shuffle, whatever the skew. A null text counts as empty
    and gives no ids; a null or repeated id stays on its row; other columns are not
    read. Decoding writes U+FFFD for bytes that are no UTF-8.
    """
    small_batches(df.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                ids = [np.frombuffer(x, "<u4") for x in model.encode(data, offsets)]
                texts = [model.decode(x).decode("utf-8", "replace") for x in ids]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[low:high], pa.ListArray.from_arrays(pa.array(ends), values), pa.array(texts, pa.string())],
                    ["id", "ids", "decoded"],
                )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "id long, ids array<int>, decoded string")


def token_digests(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode_texts`` gives.

    The same encoder and decoder, with the digests taken inside the task so that
    neither ids nor texts leave it.
    """
    small_batches(df.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                counts, of_ids, of_text = [], [], []
                for raw in model.encode(data, offsets):
                    counts.append(len(raw) // 4)
                    of_ids.append(hashlib.sha256(raw).hexdigest())
                    text = model.decode(np.frombuffer(raw, "<u4")).decode("utf-8", "replace")
                    of_text.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[low:high], pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
