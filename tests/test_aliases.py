"""Aliases by an automaton against regular expressions, one by one."""

import random
import re

from sigloom.operators import aliases


def test_hits_are_those_of_each_alias_alone(spark, monkeypatch):
    rng = random.Random(7)
    parts = ["claude", "opus", " ", " ", "-", "模型", "新", "5", "x", "GPT", "かな", ".", "Opus 5", "\n"]
    names = [(t, "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))) for t in range(12) for _ in range(3)] + [(1, "ai"), (2, None), (3, "病"), (1, "claude opus")]
    rows = [(i, "".join(rng.choice(parts) for _ in range(8)), "".join(rng.choice(parts) for _ in range(rng.randint(0, 400)))) for i in range(40)] + [(90, None, None), (91, "病 claude opus", "")]
    want = {}
    for key, title, content in rows:
        for target in range(12):
            own = {a.strip().lower() for t, a in names if t == target and a and (len(a.strip()) >= 3 or re.search(aliases.HAN, a))}

            def held(alias, text):
                text = text.lower()
                return alias in text if re.search(aliases.WITHOUT_BLANKS, alias) else re.search(r"(?<![0-9a-z])" + re.escape(alias) + r"(?![0-9a-z])", text) is not None

            body = (content or "")[: aliases.BODY]
            found = (any(held(a, title or "") for a in own), sum(held(a, body) for a in own), any(held(a, body[: aliases.LEAD]) for a in own))
            if any(found):
                want[key, target] = found
    table = spark.createDataFrame(rows, "id bigint, title string, content string")
    named = spark.createDataFrame(names, "target_id bigint, alias string")
    for most in (200_000, 9):  # one automaton, or several in turn
        monkeypatch.setattr(aliases, "MOST", most)
        assert {(r.id, r.target_id): (r.in_title, r.n_body, r.in_lead) for r in aliases.alias_hits(table, named).collect()} == want
    assert aliases.alias_hits(table, named.limit(0)).count() == 0 == aliases.alias_hits(table.limit(0), named).count()
