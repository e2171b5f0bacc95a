import hashlib
import re

import pytest

import corpus_pipeline
from tests.llm.test_models_and_search import components, sets_of

LOWER = {j: j + 32 for j in range(65, 91)}

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
    assert 0.5 * counts[0] < counts[1] <= counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    assert docs.where("decoded != text").count() == 0 and docs.where("n_tokens > 0").count() > 0


def test_a_group_of_copies_keeps_one_text(spark, doc_table):
    copies, line = "the only copy of this text\nand its second line", "a line that all have"
    rows = [(i, copies, "s") for i in range(5, 17)] + [(i, f"{line.upper() if i % 2 else line}\nown {i}", "s") for i in range(20, 32)] + [(40, None, "s")]
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, doc_table(rows), SF).collect()}
    want = {i: copies if i == 5 else "" for i in range(5, 17)} | {i: f"{line}\nown 20" if i == 20 else f"own {i}" for i in range(20, 32)} | {40: ""}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_stages_against_brute_force(spark):
    """The deterministic stages, each on its own input, on the smallest tables."""
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]

    keys = lambda t: [x.strip(" \t\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")]
    having = {}
    for r in rows:
        for k in set(keys(r["text"])) - {""}:
            having.setdefault(k, []).append(r["doc_id"])
    gone = {k: min(d) for k, d in having.items() if len(d) >= 10}
    want = {r["doc_id"]: "\n".join(x for x, k in zip((r["text"] or "").split("\n"), keys(r["text"])) if gone.get(k, r["doc_id"]) == r["doc_id"]) for r in rows}
    got = stages["line_dedup"](spark, docs, SF)
    assert gone and {r.doc_id: r.text for r in got.collect()} == want and got.where("n_chars != char_length(text)").count() == 0

    least = components(sets_of({r["doc_id"]: r["text"] for r in rows}, 5), 80)
    kept = stages["minhash_near_dedup"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {d for d, c in least.items() if c == d} and kept.columns == docs.columns

    sizes = {r["doc_id"]: len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in rows}
    source = {}
    for r in rows:
        source[r["source"]] = source.get(r["source"], 0) + sizes[r["doc_id"]]
    order = sorted(source, key=lambda s: (s is None, s or ""))
    weight, target, open_ = {s: 1 + i % 3 for i, s in enumerate(order)}, {}, set(order)
    while True:
        left, shares = sum(source.values()) - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > 3 * source[s] * shares}
        if not over:
            break
        target |= {s: 3 * source[s] for s in over}
        open_ -= over
    target |= {s: left * weight[s] / shares for s in open_}
    copies = {}
    for r in rows:
        rate = target[r["source"]] / source[r["source"]] if source[r["source"]] else 0
        draw = int(hashlib.md5(f"{r['doc_id']}:mix".encode()).hexdigest()[:8], 16) / 2**32
        copies[r["doc_id"]] = int(rate) + (draw < rate - int(rate))
    mixed = stages["source_mixing"](spark, docs, SF)
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {d: n for d, n in copies.items() if n}
    for s in open_:  # whole documents are drawn: within four standard errors
        mine = [r["doc_id"] for r in rows if r["source"] == s]
        p = target[s] / source[s] % 1
        error = sum(sizes[d] ** 2 * p * (1 - p) for d in mine) ** 0.5
        assert abs(sum(copies[d] * sizes[d] for d in mine) - target[s]) <= 4 * error + 1

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in rows}
    for r in stages["sentencepiece"](spark, docs, SF).collect():
        t = texts[r.doc_id]
        assert r.ids == (None if t is None else lib.encode(t)) and r.decoded == t
