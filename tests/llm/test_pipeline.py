"""The corpus pipeline, stage by stage, on its own input."""

import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from farewheel.llm.queries import tokenizer

from test_deduplication import brute_components, brute_repeats

SF = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        now = spark.read.parquet(path)
        out.append((name, docs.collect(), now.collect()))
        docs = now
    return {name: (before, after) for name, before, after in out}


def test_stages_and_columns(steps):
    assert list(steps) == ["toxicity", "ngram_jaccard", "substring_dedup", "source_mixing", "bpe"]
    for name, (_, after) in steps.items():
        if name != "bpe":
            assert set(after[0].asDict()) == set(pipeline.COLUMNS)


def test_toxic_documents_go(spark, steps):
    """On the table with some 450 toxic labels; sf0.01 has 45 to learn from."""
    docs = spark.read.parquet(f"{LARGE}/documents.parquet")
    kept = {r.doc_id for r in pipeline.drop_toxic(spark, docs, LARGE).select("doc_id").collect()}
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    marked = [d for d, t in toxic.items() if t == 1]
    clean = [d for d, t in toxic.items() if t == 0]
    assert sum(d in kept for d in marked) <= 0.1 * len(marked)
    assert sum(d in kept for d in clean) >= 0.99 * len(clean)
    before, after = steps["toxicity"]
    assert {tuple(r) for r in after} <= {tuple(r[c] for c in after[0].asDict()) for r in before}


def test_one_of_each_group_stays(steps):
    before, after = steps["ngram_jaccard"]
    wanted = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in before]) if d == c}
    assert sorted(r.doc_id for r in after) == sorted(wanted)


def test_repeated_passages_go(steps):
    before, after = steps["substring_dedup"]
    wanted = sorted((d, t) for d, _, _, _, t in brute_repeats([(r.doc_id, r.text) for r in before]))
    assert sorted((r.doc_id, r.text) for r in after) == wanted
    assert all(r.n_chars == len(r.text) for r in after)
    assert {(r.doc_id, r.lang, r.source) for r in before} == {(r.doc_id, r.lang, r.source) for r in after}


def test_mix_takes_whole_documents_up_to_twice(steps):
    before, after = steps["source_mixing"]
    counts = Counter(r.doc_id for r in after)
    assert max(counts.values()) <= 2 and set(counts) <= {r.doc_id for r in before}
    words = sum(len(r.text.split()) for r in before)
    assert abs(sum(len(r.text.split()) for r in after) - 1.5 * words) < 0.02 * words


def test_encoding_equals_the_library(steps):
    before, after = steps["bpe"]
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    sha = lambda ids: hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    wanted = Counter((r.doc_id, sha(library.encode(r.text, add_special_tokens=False).ids)) for r in before)
    assert Counter((r.doc_id, r.ids_sha256) for r in after) == wanted


def test_stages_take_odd_tables(spark, docs, odd):
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs(*odd), SF).count() > 0
        assert stage(spark, docs(*odd).limit(0), SF).count() == 0


def test_texts_under_one_id_stay_or_go_alone(spark, docs):
    words = lambda n: [f"w{n}x{i}" for i in range(40)]
    near = lambda n: " ".join([*words(n)[:-1], "else"])
    text = lambda n: " ".join(words(n))
    rows = [
        (1, text(1)), (2, near(1)), (2, text(2)),   # only the near copy of id 1 goes
        (3, text(3)), (3, near(3)),                 # near copies under one id: one stays
        (4, text(4)), (4, text(4)),                 # a repeated row
        (-5, near(6)), (6, text(6)),                # the smallest id stays
        (None, text(7)), (None, text(7)), (8, None), (8, ""),
    ]
    got = [(r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs(*rows), SF).collect()]
    assert Counter(r for r in got if r[0] != 3) == Counter([
        (1, text(1)), (2, text(2)), (4, text(4)), (-5, near(6)), (None, text(7)), (None, text(7)), (8, None), (8, "")])
    assert len([r for r in got if r[0] == 3]) == 1
