"""The pipeline against plain Python versions of its stages."""

import hashlib
import random

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

import corpus_pipeline  # noqa: E402
from folioframe.llm import bpe, quality  # noqa: E402

from test_decontaminate import plain as windows  # noqa: E402
from test_linechunks import plain as lines  # noqa: E402
from test_sigtree import plain as copies  # noqa: E402


def test_against_plain(spark, tmp_path):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(300)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n)).capitalize() + "."
    shared = "\n".join(line(30) for _ in range(6))
    items = [(k, line(25)) for k in range(4)] + [(9, None)]
    texts = []
    for k in range(120):
        t = [line(r.randint(5, 30)) for _ in range(r.randint(1, 6))]
        if k % 5 == 0:
            t.insert(1, shared)
        if k % 17 == 0:
            t.append(items[k % 4][1])
        texts.append("\n".join(t) if k % 6 else " ### ".join(x.upper() + "!!" for x in t[0].split()) * 3)
    texts += [texts[7], texts[8].replace(" ", "  "), texts[9] + " tail", None, ""]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    labels = [(k, int(k % 6 > 0), 0) for k in range(0, 120, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    kept = {x.doc_id for x in corpus_pipeline.filter_quality(spark, docs, str(tmp_path)).collect()}
    model = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), corpus_pipeline.train_on())
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        score = model.score(quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[0]
        assert (k in kept) == (score >= 0.5)
    assert sum((k in kept) == (k % 6 > 0) for k in range(120)) >= 108
    left = [(k, t) for k, t in lines([(k, texts[k]) for k in sorted(kept)]) if t == texts[k] or t.strip(" \n\t")]
    groups = copies([(k, t) for k, t in left])
    left = [(k, t) for k, t in left if groups[k][1] == k]
    left = [(k, t) for k, t in left if not windows(t, items)[4]]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = set()
    for k, t in left:
        ids = library.encode_ordinary(t or "")
        want.add((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert {tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
    assert 0 < len(want) < len(kept)
