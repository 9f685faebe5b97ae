import base64
import hashlib
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm import fixtures
from tideline.llm import bpe, queries, token_counts, token_store
from tideline.llm.bpe import MergeReplay
from tideline.llm.common import shared_dir
from tideline.llm.library_tokens import encoder

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def collected(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_token_store(spark, library):
    rows = fixtures.rows()
    got = token_store.store_and_verify(fixtures.frame(spark), JSON, end_id=2)
    ids = [library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows]
    want = Counter((r[0], len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(rows, ids))
    assert collected(got, "doc_id", "n_tokens", "ids_crc32") == want
    by_start = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in got.collect())
    assert [s for s, _, _ in by_start] == [0, *np.cumsum([n for _, n, _ in by_start])[:-1].tolist()]
    order = [d for _, _, d in by_start]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert token_store.store_and_verify(fixtures.empty(spark), JSON, end_id=2).collect() == []


def test_token_store_files(spark, library):
    folder = shared_dir(spark, "store-test")
    docs = fixtures.frame(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    token_store.write_store(docs, folder, JSON, end_id=2)
    got = {r["id"]: r["ids"] for r in token_store.read_ids(spark, folder).collect()}
    assert got == {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in docs.collect()}
    keys = spark.read.parquet(f"{folder}/staged/kind=chunk").select("key").collect()
    assert len({bytes(k[0]) for k in keys}) == len(keys)
    root = token_store.dataset_root(spark, folder)
    assert len(root) == 64 and root == token_store.dataset_root(spark, folder)


def _files(spark, folder, part):
    return sorted(Path(folder.removeprefix("file:")).glob(f"{part}/*.parquet"))


@pytest.mark.parametrize("part,flip", [("staged/kind=chunk", False), ("staged/kind=chunk", True), ("recipes/kind=0", False), ("recipes/kind=0", True), ("recipes/kind=1", False)])
def test_damage_is_an_error(spark, part, flip):
    """A file that is gone, or a byte that is not what it was."""
    folder = shared_dir(spark, "damaged")
    token_store.write_store(fixtures.frame(spark), folder, JSON, end_id=2)
    assert token_store.verify(spark, folder).count() == len(fixtures.rows())
    victim = max(_files(spark, folder, part), key=lambda p: p.stat().st_size)
    if flip:
        raw = bytearray(victim.read_bytes())
        raw[len(raw) // 3] ^= 1
        victim.with_name(f".{victim.name}.crc").unlink()
        victim.write_bytes(raw)
    else:
        victim.unlink()
    with pytest.raises(Exception, match="do not match|does not match|missing or altered|orrupt|ecompress|inconsistent"):
        token_store.verify(spark, folder).collect()


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 50_000, 20_000).astype(np.int32)
    b = np.concatenate([rng.integers(0, 50_000, 77).astype(np.int32), a])
    one, two = (token_store.cuts(x, np.array([0])) for x in (a, b))
    assert len(set((one + 77).tolist()) & set(two.tolist())) > 0.8 * len(one)
    sizes = np.diff(one, prepend=0)
    assert sizes.max() <= 4096 and (sizes[:-1] >= 128).all() and one[-1] == len(a)


def test_crc_of_parts():
    rng = np.random.default_rng(2)
    parts = [rng.bytes(n) for n in (0, 1, 5000, 17)]
    behind = np.array([sum(map(len, parts[k + 1 :])) for k in range(4)])
    got = np.bitwise_xor.reduce(token_store.crc_before(np.array([zlib.crc32(p) for p in parts]), behind))
    assert got == zlib.crc32(b"".join(parts))


@pytest.mark.parametrize("chunk,overlap", [(16_384, 256), (4096, 256), (70, 64)])
def test_token_counts(spark, library, chunk, overlap):
    got = token_counts.count_tokens(fixtures.frame(spark), JSON, chunk=chunk, overlap=overlap)
    want = Counter()
    for r in fixtures.rows():
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids)
        want[r[0], len((r[1] or "").encode()), n, n > 512] += 1
    assert collected(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(fixtures.empty(spark), JSON).collect() == []


def test_counts_of_a_table_come_by_splices(spark):
    where = "/root/testdata/sf0.01"
    rows = queries.op7_token_counts(spark, where).collect()
    #: The first chunk reads its overlap, too.
    long = sum(len((r["text"] or "").encode()) > 4096 + 256 for r in spark.read.parquet(f"{where}/documents.parquet").collect())
    assert sum(r["n_splices"] > 0 for r in rows) == long > 100


def test_splices_and_widening(library):
    _, units = encoder(JSON)
    count = lambda text: token_counts.spliced_counts([text.encode()], units, 1000, 64)[0]
    for text in ("word " * 5000, "x" * 9000, "ab  \n " * 2000, "!" * 4000 + " tail", "日本語 " * 900):
        total, splices, widened = count(text)
        assert total == len(library.encode(text, add_special_tokens=False).ids)
    assert count("word " * 5000)[1] > 10
    assert count("x" * 9000)[2] > 0


def test_bpe(spark, ranked):
    got = bpe.encode_decode(fixtures.frame(spark), RANKS, P.PATTERN, with_ids=True, with_text=True)
    want = Counter()
    for r in fixtures.rows():
        ids = ranked.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert collected(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    texts = {r[0]: r[1] or "" for r in fixtures.rows() if r[0] is not None}
    assert all(texts[r["doc_id"]] == r["decoded"] and len(r["ids"]) == r["n_tokens"] for r in got.where("doc_id IS NOT NULL").collect())
    assert bpe.encode_decode(fixtures.empty(spark), RANKS, P.PATTERN).collect() == []


def plain_merges(ranks, word):
    """The lowest pair first, the leftmost of equal ones."""
    parts = [bytes([b]) for b in word]
    while word not in ranks and len(parts) > 1:
        rank, i = min((ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[word]] if word in ranks else [ranks[x] for x in parts]


@pytest.mark.parametrize("stepwise", [False, True])
def test_replay_equals_plain_loop(stepwise):
    own = MergeReplay(RANKS, P.PATTERN)
    rng = np.random.default_rng(5)
    words = [rng.choice(list(b"aabbe nst\xc3\xa9"), rng.integers(1, 40)).astype(np.uint8).tobytes() for _ in range(400)] + [b"aaaaaaaaaaa", b"a"]
    size, ids = own.replay(words, stepwise)
    at = 0
    for w, n in zip(words, size.tolist()):
        assert ids[at : at + n].tolist() == plain_merges(own.ranks, w)
        at += n


def test_early_pairs_are_taken_in_their_turn(tmp_path):
    """Ranks in which a merge makes a pair that ranks before it, with several such places in a word."""
    made = [b"ab", b"bc", b"abca", b"cab", b"abc", b"ca", b"caa", b"bca"]
    rng = np.random.default_rng(8)
    words = [rng.choice(list(b"abc"), rng.integers(1, 30)).astype(np.uint8).tobytes() for _ in range(300)]
    for turn in range(6):
        order = [made[k] for k in rng.permutation(len(made))]
        path = tmp_path / f"{turn}.tiktoken"
        tokens = [bytes([b]) for b in range(256)] + order
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
        own = MergeReplay(str(path), P.PATTERN)
        size, ids = own.replay(words)
        want = [plain_merges(own.ranks, w) for w in words]
        assert size.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
