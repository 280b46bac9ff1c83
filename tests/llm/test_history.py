"""Version histories against a day-by-day definition."""

import hashlib
import random

from quire.llm.history import CORRECTION, DELETE, UPDATE, changes_of, versions

SCHEMA = "doc_id long, start int, kind int, value string, arrived long"


def by_days(changes, days=365, span=3):
    """{key: [(version, from, to, value)]} by asking each day."""
    out = {}
    for key in {c[0] for c in changes}:
        mine = [c for c in changes if c[0] == key and c[1] is not None and 0 <= c[1] < days and c[2] in (UPDATE, DELETE, CORRECTION)]
        rank = lambda c: (c[4] is not None, c[4] or 0, c[2], c[3] is not None, c[3] or "")
        cells = []
        for day in range(days + span):
            over = [c for c in mine if c[2] == CORRECTION and c[1] <= day < c[1] + span]
            base = [c for c in mine if c[2] != CORRECTION and c[1] <= day]
            c = max(over, key=rank) if over else max(base, key=lambda c: (c[1], rank(c))) if base else None
            cells.append(None if c is None or c[2] == DELETE else (c[3],))
        found, begin = [], 0
        for day in range(1, days + span + 1):
            if day == days + span or cells[day] != cells[begin]:
                if cells[begin]:
                    found.append((len(found) + 1, begin, None if day == days + span else day, cells[begin][0]))
                begin = day
        if found and key is not None:
            out[key] = found
    return out


def as_dict(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["version"], r["valid_from"], r["valid_to"], r["value"]))
    return {k: sorted(v) for k, v in out.items()}


def test_random_changes(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(40), rng.randrange(365), rng.randrange(3), rng.choice(["a", "b", "c", None]), rng.randrange(100)) for _ in range(600)]
    rows += [(41, rng.randrange(365), rng.choice([0, 0, 1, 2, 2]), f"v{rng.randrange(9)}", i) for i in range(3000)]  # one hot key
    rows += rows[:50]
    assert as_dict(versions(spark.createDataFrame(rows, SCHEMA))) == by_days(rows)


def test_edge_cases(spark):
    rows = [
        (1, 364, CORRECTION, "end", 1), (2, 5, UPDATE, None, 1), (2, 5, DELETE, None, 0), (3, 9, DELETE, "x", 1), (4, 0, UPDATE, "a", 1), (4, 7, UPDATE, "a", 2), (4, 9, CORRECTION, "a", 0),
        (None, 3, UPDATE, "n", 1), (5, None, UPDATE, "n", 1), (6, 365, UPDATE, "n", 1), (7, -1, UPDATE, "n", 1), (8, 3, None, "n", 1), (9, 3, 7, "n", 1), (10, 4, UPDATE, "t" * 300_000, None), (10, 4, UPDATE, "u", None),
        (11, 2, UPDATE, None, 1), (11, 6, CORRECTION, "z", 2), (11, 7, CORRECTION, None, 3),
    ]
    df = spark.createDataFrame([(*r, "other", 5) for r in rows], SCHEMA + ", version string, __q_key int")
    got = as_dict(versions(df))
    assert got == by_days(rows)
    assert got[1] == [(1, 364, 367, "end")] and got[2] == [(1, 5, None, None)] and 3 not in got and got[4] == [(1, 0, None, "a")]
    assert versions(df.limit(0)).count() == 0
    assert versions(df.where("doc_id = 3")).count() == 0


def test_changes(spark):
    docs = spark.createDataFrame([(7, "en"), (None, "de"), (-3, None), (7, "en")], "doc_id long, lang string")
    got = sorted(map(tuple, changes_of(docs).select("made_by", "j", "doc_id", "start", "kind", "value", "h").distinct().collect()))
    want = []
    for i, lang in ((-3, None), (7, "en")):
        for j in (0, 1):
            h = int(hashlib.sha256(f"{i}:{j}".encode()).hexdigest()[:12], 16)
            digit = h // 1000 % 10
            want.append((i, j, i - i % 5, h % 365, DELETE if digit < 2 else CORRECTION if digit < 5 else UPDATE, lang, h))
    assert got == want
