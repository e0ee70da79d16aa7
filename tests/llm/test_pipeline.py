from collections import Counter, defaultdict

import public_tokenizers
import tiktoken

import corpus_pipeline as pipeline
from textquarry.llm import pu_quality
from textquarry.llm.queries import quality_labels

from test_alike import alike_pairs, components
from test_mixing import targets
from test_quality import brute_features

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)

    model = pu_quality.fit(docs, quality_labels(spark, SF))
    good = stages["quality_classifier"](spark, docs, SF).cache()
    want = {r.doc_id for r in docs.collect() if brute_features(r.text, model.known) @ model.weights >= 0}
    assert {r.doc_id for r in good.collect()} == want and good.columns == docs.columns

    unique = stages["exact_duplicates"](spark, good, SF).cache()
    last = {}
    for r in good.collect():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert Counter(r.doc_id for r in unique.collect()) == Counter(last.values()) and unique.columns == docs.columns

    apart = stages["near_duplicates"](spark, unique, SF).cache()
    # Who goes has a document of its group that is alike, up to the links that fingerprints miss; who is clean stays.
    rows = [(r.doc_id, r.text) for r in unique.collect()]
    pairs = alike_pairs(rows)
    groups, stay = components([i for i, _ in rows], pairs), {r.doc_id for r in apart.collect()}
    assert pairs and apart.columns == docs.columns and apart.count() == len(stay)
    assert set(groups.values()) <= stay and len(stay - set(groups.values())) <= 0.1 * (len(rows) - len(set(groups.values())))

    mixed = stages["source_mixture"](spark, apart, SF).cache()
    sizes, longest = defaultdict(int), defaultdict(int)
    for r in apart.collect():
        sizes[r.source] += len(r.text.encode().split())
        longest[r.source] = max(longest[r.source], len(r.text.encode().split()))
    taken = defaultdict(int)
    for r in mixed.collect():
        taken[r.source] += len(r.text.encode().split())
    goal = targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1 for s in goal) and mixed.columns == docs.columns
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2

    done = stages["byte_bpe"](spark, mixed, SF)
    assert Counter(r.doc_id for r in done.collect()) == Counter(r.doc_id for r in mixed.collect())


def test_stages_stand_odd_rows(spark, odd, clashing, none):
    for docs in (odd, clashing, none):
        for name, stage in pipeline.STAGES:
            rows = stage(spark, docs, SF)
            assert name == "byte_bpe" or rows.columns == docs.columns
            rows.collect()


def test_run_is_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    want = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in pipeline.STAGES[-1][1](spark, docs, SF).collect())
    rows = pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in rows) == want
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    encoding = tiktoken.Encoding("b", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    assert all(list(r.ids) == encoding.encode_ordinary(texts[r.doc_id]) for r in rows)


def ranks():
    import base64

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in f if line.strip()}
