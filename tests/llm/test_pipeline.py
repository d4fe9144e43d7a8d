import re

import numpy as np
import pytest
import sentencepiece

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from weft.llm import pieces  # noqa: E402

from .test_lines import brute as brute_lines  # noqa: E402
from .test_simhash import brute as brute_groups  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "mo ta ri su ne lo".split() for b in "ken dal fis por gun mit".split() for c in "a e o".split()]
    bench = [(i, " ".join(rng.choice(words, 30))) for i in range(5)]
    docs, toxic = [], {}
    for i in range(120):
        lines = [" ".join(rng.choice(words, rng.integers(8, 40))) + "." for _ in range(rng.integers(1, 5))]
        if toxic.setdefault(i, int(i % 5 == 1)):
            lines = [re.sub(" ", f" {['grumhead', 'grumpets'][k % 2]} ", x, count=2) for k, x in enumerate(lines)]
        if i % 11 == 3:
            lines.insert(0, bench[i % 5][1])
        if i % 13 == 4:
            lines.append("a notice that stands under many of the texts")
        docs.append((i, "\n".join(lines), "en", f"src{i % 3}", 0))
    docs += [(200 + k, docs[k][1], "en", "src0", 0) for k in range(0, 12)]
    docs += [(300, None, None, None, None), (301, "", "en", "src1", 0), (302, "\n", "en", "src1", 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(bench), toxic


def test_each_stage_on_what_the_last_kept(spark, tables):
    path, bench, toxic = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(f"{path}/{name}")
        out = spark.read.parquet(f"{path}/{name}")
        got = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            bad = {i for i, r in rows.items() if "grum" in (r.text or "")}
            assert set(rows) - set(got) == bad and all(got[i] == rows[i] for i in got)
        elif name == "line_dedup":
            gone = brute_lines([(i, r.text) for i, r in rows.items()])
            for i, r in rows.items():
                kept = None if r.text is None else "\n".join(x for p, x in enumerate(r.text.split("\n")) if (i, p) not in gone)
                assert got[i].text == kept and (kept == r.text or got[i].n_chars == len(kept))
        elif name == "near_duplicates":
            assert set(got) == {i for i, _, c in brute_groups([(i, r.text) for i, r in rows.items()]) if i == c}
        elif name == "decontamination":
            held = {i for i, r in rows.items() if any(b in (r.text or "") for b in bench.values())}
            assert set(rows) - set(got) == held and held
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
            assert {i: r.ids for i, r in got.items()} == {i: [*library.encode(r.text or ""), library.eos_id()] for i, r in rows.items()}
        if k < 4:
            assert out.columns == columns
        docs, rows = out, got
    final = {(r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, path).collect()}
    assert final == {(i, tuple(r.ids)) for i, r in rows.items()}


def test_empty_tables(spark, tables, tmp_path):
    path = tables[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
