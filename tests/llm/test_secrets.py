import hashlib
import re

import numpy as np

from weft.llm import secrets

TEXTS = [
    "password=short password = 'longenough1' token:abc",
    "PASSWORD=\"A1b2C3d4\" apikey=xx api_key : 12345678 ſecret=12345678",
    "secret=password=abcdefgh",
    "AKIA AKIAABCDEFGH AKIAABCDEFGHIJKL AKIAAKIAAKIAAKIA1",
    "f" * 31 + " " + "0" * 32 + "g" + "a" * 40,
    "token = \"0123456789abcdef0123456789abcdef01234567\"",
    "", None, "ü" * 5 + " password=äbcdefghi", "nothing here",
]


def plain(text):
    """The rules once more, match by match."""
    out = []
    for k, pattern, least, group in (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 8, 2),
        ("access", "AKIA[A-Z0-9]+", 16, 0),
        ("hex", "[0-9a-f]+", 32, 0),
    ):
        at = 0
        while m := re.compile(pattern, re.ASCII).search(text or "", at):
            if len(m[group]) >= least:
                out.append((m.start(), ["assign", "access", "hex"].index(k), m.end()))
            at = m.end()
    return sorted(out)


def test_rules():
    for text in TEXTS:
        assert secrets.base_spans(text or "") == plain(text), text


def test_scan_and_query_columns(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3]), (0, TEXTS[0])]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as h").write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op9_secrets(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[3] if r.doc_id is None else TEXTS[r.doc_id]
        spans = plain(text)
        told = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert set(told.split(",")) <= set(r.spans.split(",")) or not told


def test_chains_tell_random_from_ordinary():
    rng = np.random.default_rng(0)
    syllables = ["th", "er", "ing", "tion", "an", "re", "ness", "com", "pro", "ly"]
    words = ["".join(rng.choice(syllables, 7)) for _ in range(4000)]
    model = secrets.Model(secrets._planted(2000, 1), words[:3000])
    fresh = secrets._planted(400, 2)
    assert np.mean(model.scores(fresh) > model.threshold) > 0.97
    assert np.mean(model.scores(words[3000:]) > model.threshold) < 0.01


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = secrets.fit(empty)
    assert secrets.scan(empty, model).count() == 0
