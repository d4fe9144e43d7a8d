import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from weft.llm import token_counts

TEXTS = ["one line", "two lines\nof it\n", "", "\n\n\n", "é漢\U0001f600\nünder  the\r\n x", "don't\n\nstop", "a" * 300 + "\nb", "end ", "mid<|endoftext|>\n<|endoftext|> x\n"]


@pytest.fixture(scope="module")
def whole():
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return out


def brute(whole, text, spans, rule):
    """Tokens of each span by the library's offsets, byte by byte."""
    encoded = whole.encode(text, add_special_tokens=False)
    owner = [-1] * len(text.encode())
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    for k, (a, b) in enumerate(spans):
        for byte in range(at[a], at[b]):
            owner[byte] = k
    widths = token_counts.token_bytes()
    counts, pos = [[0, 0] for _ in spans], 0
    for i, (a, b) in zip(encoded.ids, encoded.offsets, strict=True):
        own = owner[pos : pos + widths[i]]
        assert at[a] <= pos and pos + widths[i] <= at[b]  # within the library's characters
        pos += widths[i]
        k = own[0] if rule == "first" else max(dict.fromkeys(own), key=own.count)
        if k >= 0:
            counts[k][0] += 1
            counts[k][1] += len(set(own)) > 1
    assert pos == len(text.encode())
    return counts


def lines(text):
    cuts = [0, *(k + 1 for k, c in enumerate(text) if c == "\n")]
    return list(zip(cuts, [*cuts[1:], len(text)], strict=True))


def test_lines(spark, whole):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id\nhere"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as section", "2 as start")
    got = sorted((tuple(r) for r in token_counts.section_tokens(df).collect()), key=str)
    want = []
    for i, t in rows:
        for k, ((a, b), (n, c)) in enumerate(zip(lines(t or ""), brute(whole, t or "", lines(t or ""), "first"), strict=True)):
            want.append((i, k, a, b, n, c))
    assert got == sorted(want, key=str)
    assert sum(r[4] for r in want) == sum(len(whole.encode(t or "", add_special_tokens=False).ids) for _, t in rows)
    assert token_counts.section_tokens(df.limit(0)).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_any_sections(spark, whole, rule):
    rng = np.random.default_rng(0)
    rows = []
    for i, t in enumerate(TEXTS * 6):
        cuts = sorted(rng.integers(0, len(t) + 1, 6).tolist())
        rows.append((i, t, [(cuts[0], cuts[1]), (cuts[2], cuts[3]), (cuts[4], cuts[5])]))
    df = spark.createDataFrame([*rows, (90, "abc", None), (91, "abc", [(None, 1), (1, 99)])], "doc_id long, text string, parts array<struct<start: int, end: int>>")
    got = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens, r.n_crossing) for r in token_counts.section_tokens(df, sections_column="parts", rule=rule).collect()}
    for i, t, spans in rows:
        for k, ((a, b), (n, c)) in enumerate(zip(spans, brute(whole, t, spans, rule), strict=True)):
            assert got[i, k] == (a, b, n, c), (t, spans, rule)
    assert (90, 0) not in got and got[91, 0][:2] == (1, 3)
