"""The toxicity score against a plain one: words restored by enumeration, weights added up one by one; and its sample."""

import math
import random
import zlib

from lexmill.llm import toxicity

from .test_operators import enumerated


def test_scores_against_plain_sums(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = toxicity.learn(docs, labels)
    chars = toxicity.CharModel(toxicity.np.frombuffer(model.counts, toxicity.np.int64))
    known = [w for w in {x for r in docs.limit(200).collect() for x in r.text.lower().split()} if w.isascii() and w.isalpha() and 3 < len(w) < 9 and not any(a == b for a, b in zip(w, w[1:]))]
    random.seed(11)
    signs = str.maketrans({"a": "4", "e": "3", "i": "1", "o": "0", "s": "$"})
    weights = model.weights
    texts = []
    for _ in range(40):
        plain = random.sample(known, 12) + random.choices(["stupid", "idiot", "loser", "scum"], k=random.randint(0, 3))
        texts.append([w.translate(signs) if random.random() < 0.4 else w for w in plain])
    for written in texts:
        # A word without a sign stands as written; one with signs and a letter is the likeliest of all its readings.
        words = {w if w.isalpha() else enumerated(w, chars)[1] if any(c.isalpha() for c in w) else w for w in written}
        z = model.bias
        for w in sorted(words):
            for name in [b"w" + w.encode()] + [b"%d" % n + w[:n].encode() for n in (4, 5) if len(w) >= n]:
                z += float(weights[zlib.crc32(name) % toxicity.BUCKETS])
        want = 1 / (1 + math.exp(-min(max(z, -30), 30)))
        got = toxicity.Scorer(model.counts, weights.tobytes(), model.bias).score(" ".join(written))
        assert abs(got - want) < 1e-6, written


def test_rows_of_the_sample_keep_all_features(spark):
    """A long text's words all teach, whatever their buckets; a bound on features leaves out rows, never words."""
    long = " ".join(f"w{'abcdefghij'[k % 10]}{k:05d}x".translate(str.maketrans("0123456789", "qrtvbnmkzy")) for k in range(3000))
    rows = [(k, long if k == 6 else f"vile word{k}" if k % 2 else f"kind word{k}") for k in range(1, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    given = spark.sparkContext.broadcast(toxicity.trigram_counts(docs).tobytes())
    taught, n = toxicity.sample(docs, labels, given)
    held = {k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0}
    assert len(taught) == len(rows) - len(held) == sum(n.values())
    assert 6 in held or max(len(f) for f, _ in taught) > 2_048
    few, _ = toxicity.sample(docs, labels, given, features_in_all=20)
    assert 2 <= len(few) < len(taught) and {y for _, y in few} == {0, 1}
    sizes = sorted(len(f) for f, _ in taught)
    assert all(len(f) in sizes for f, _ in few)
