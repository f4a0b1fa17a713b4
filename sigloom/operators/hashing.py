"""The hashing embedding: signed sums of word hashes, of length one, without a row for each word."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places of the embedding, and what a word is made of.
PLACES = 256
WORD = "[0-9a-zA-Z一-鿿぀-ヿ가-힣]+"
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000


def hash_embeddings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, bucket, weight and x for every place that a word of the row's whole text falls into: the signed sum of its
    words and that over the vector's length (0 where all sums are 0).  Texts without words, null ones too, have no place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = re.compile(WORD).findall, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                owners, buckets, weights, values = [], [], [], []
                for k, content in enumerate(part.column(1).to_pylist()):
                    codes = []
                    for word in words(content or ""):
                        code = known.get(word)
                        if code is None:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            # The last byte is the place, the bit above it the sign.
                            code = known[word] = int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[-3:], 16) & 0x1FF
                        codes.append(code)
                    if codes:
                        counts = np.bincount(np.array(codes), minlength=2 * PLACES).reshape(2, PLACES)
                        some = np.flatnonzero(counts.any(axis=0))
                        weight = (counts[1] - counts[0])[some]
                        owners.append(np.full(len(some), k))
                        buckets.append(some)
                        weights.append(weight)
                        values.append(weight / (np.sqrt(np.square(weight).sum()) or 1.0))
                if owners:
                    columns = [part.column(0).take(pa.array(np.concatenate(owners))), pa.array(np.concatenate(buckets).astype(np.int32)), pa.array(np.concatenate(weights).astype(np.int64)), pa.array(np.concatenate(values))]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, "bucket", "weight", "x"])

    return rows.select(key, F.lower(text).alias("text")).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, bucket int, weight bigint, x double")
