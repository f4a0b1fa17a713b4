"""The hashing embedding against a plain walk over words."""

import hashlib
import math
import re

from sigloom.operators import hashing

TEXTS = [None, "", "...", "One two, TWO", "混合 text 日本語ひらがな 한국어 naïve x", "a " * 5000 + "b", "same same"]


def plain(text):
    vector = [0] * 256
    words = re.findall(hashing.WORD, (text or "").lower())
    for word in words:
        h = int(hashlib.md5(word.encode()).hexdigest(), 16)
        vector[h % 256] += 1 if h >> 8 & 1 else -1
    n = math.sqrt(sum(x * x for x in vector))
    met = {int(hashlib.md5(w.encode()).hexdigest(), 16) % 256 for w in words}
    return {(b, vector[b], round(vector[b] / n, 9) if n else 0.0) for b in met}


def test_embeddings_are_those_of_a_walk(spark, monkeypatch):
    monkeypatch.setattr(hashing, "REMEMBERED", 3)
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)], "id bigint, text string, bucket int")
    found = {}
    for r in hashing.hash_embeddings(rows, "id", "text").collect():
        found.setdefault(r.id, set()).add((r.bucket, r.weight, round(r.x, 9)))
    assert found == {i: plain(t) for i, t in enumerate(TEXTS) if plain(t)}
    assert hashing.hash_embeddings(rows.limit(0), "id", "text").count() == 0
