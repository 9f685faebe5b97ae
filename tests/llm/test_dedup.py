import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from tideline.llm import near_dedup, stream_dedup
from tideline.llm.components import connected
from tideline.llm.common import shared_dir


def spaced(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


@pytest.mark.parametrize("digest", [stream_dedup.sha256, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_dedup(spark, digest):
    """The second digest clashes all the time; the full bytes tell texts apart."""
    rows = fixtures.rows()
    folder = shared_dir(spark, "given")
    fixtures.frame(spark).write.parquet(folder)
    got = stream_dedup.exact_dedup(spark, folder, digest=digest).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[spaced(r[1])].append(r[0])
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((r[0], first[spaced(r[1])], len(groups[spaced(r[1])]), hashlib.sha256(spaced(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_dedup_goes_on(spark):
    """Files that arrive later meet the state that earlier ones left."""
    folder, state = shared_dir(spark, "arriving"), shared_dir(spark, "state")
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(folder)
    make([(5, "a  b"), (6, "c")])
    once = stream_dedup.stream_state(spark, folder, "doc_id", "text", checkpoint=state)
    assert sorted((r["first"]["id"], r["n"]) for r in once.collect()) == [(5, 1), (6, 1)]
    make([(2, "a b"), (7, "d")])
    again = stream_dedup.stream_state(spark, folder, "doc_id", "text", checkpoint=state)
    assert sorted((r["first"]["id"], r["n"]) for r in again.collect()) == [(2, 2), (6, 1), (7, 1)]


def test_exact_dedup_empty_and_rows(spark):
    folder = shared_dir(spark, "none")
    fixtures.empty(spark).write.parquet(folder)
    assert stream_dedup.exact_dedup(spark, folder).collect() == []
    kept = stream_dedup.keep_first(fixtures.frame(spark))
    assert kept.columns == fixtures.COLUMNS
    texts = [spaced(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({spaced(r[1]) for r in fixtures.rows()})


# -- near duplicates


def plain_set(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def plain_groups(rows, k):
    sets = [plain_set(r[1], k) for r in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                if x != y:
                    label = [y if v == x else v for v in label]
    least = defaultdict(list)
    for v, r in zip(label, rows):
        least[v].append(r[0])
    comp = {v: min((i for i in ids if i is not None), default=None) for v, ids in least.items()}
    return [(r[0], len(s), comp[v], r[0] == comp[v]) for r, s, v in zip(rows, sets, label)]


@pytest.mark.parametrize("words", [4, 5])
def test_near_groups(spark, words):
    rows = fixtures.rows()
    got = near_dedup.near_groups(fixtures.frame(spark), words=words)
    assert Counter(map(tuple, got.collect())) == Counter(plain_groups(rows, words))
    assert any(r["doc_id"] != r["component_id"] for r in got.collect())
    assert near_dedup.near_groups(fixtures.empty(spark), words=words).collect() == []


def test_near_groups_in_blocks(spark):
    """Large buckets, in blocks of four: near copies in a chain, and texts that share most but not enough."""
    rng = np.random.default_rng(9)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join([f"u{k}_{j}" for j in range(22)] + passage)))
    words = [f"w{j}" for j in range(100)]
    for k in range(60):
        words[int(rng.integers(0, 100))] = f"n{k}"
        rows.append((100 + k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dedup.near_groups(docs, words=4, block=4)
    assert Counter(map(tuple, got.collect())) == Counter(plain_groups(rows, 4))


def test_keep_one(spark):
    kept = near_dedup.keep_one(fixtures.frame(spark), words=4)
    want = Counter(d for d, _, _, k in plain_groups(fixtures.rows(), 4) if k or d is None)
    assert kept.columns == fixtures.COLUMNS and Counter(r["doc_id"] for r in kept.collect()) == want


def test_posterior_bounds():
    least, size = near_dedup.least_matches(0.8, 1e-5), near_dedup.SIZE
    assert list(least) == sorted(least) and all(m < 0.8 * n for m, n in zip(least, near_dedup.LOOKS)) and near_dedup.LOOKS[-1] == size + near_dedup.WIDE
    rng = np.random.default_rng(3)
    split = lambda x: [x[:, :size].astype(np.uint16), x[:, size:].astype(np.uint8)]
    left = rng.integers(0, 250, (4000, size + near_dedup.WIDE))
    near, far = (np.where(rng.random(left.shape) < share, left, left + 1) for share in (0.8, 0.65))
    assert len(near_dedup.likely(split(left), split(near), 0.8, 1e-5)) >= 3998
    assert len(near_dedup.likely(split(left), split(far), 0.8, 1e-5)) <= 4


def test_signature_agreement_is_similarity():
    rng = np.random.default_rng(8)
    common = rng.integers(0, 2**63, 800).astype(np.uint64)
    a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, 200).astype(np.uint64)])) for _ in range(2))
    sign = near_dedup.signatures([a, b])
    assert abs((sign[0] == sign[1]).mean() - 800 / 1200) < 0.13
    assert [len(s) for s in near_dedup.shingle_sets(pa.array(["", None, "a b", "a b c d e f", "A  b C d e a b c d"]), 4)] == [0, 0, 1, 3, 5]


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(k, k + 1) for k in range(100, 160)] + [(3, 3), (7, 5), (5, 7)] + [(1000, 1000 + int(x)) for x in rng.integers(1, 60, 200)]
    got = {r["node"]: r["comp"] for r in connected(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and got[7] == got[5] == 5 and 3 not in got
    assert {got[k] for k in got if k >= 1000} == {1000}
    assert connected(spark.createDataFrame([], "a long, b long"), "test").collect() == []
