"""The whole pipeline against a plain version of its five stages, with decisions of earlier stages that later ones depend on."""

import hashlib
import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.fixtures import prose
from tests.llm.test_dedup import plain_set, spaced
from tests.llm.test_text_scans import LETTER, words_of
from tests.llm.test_tokens import ranked  # noqa: F401
from tideline.llm.common import shared_dir

TOXIC = "vile scum filth vermin hateful wretch".split()
PASSAGES = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "the benchmark asks how many birds sit on the wire at noon today"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """Rows (doc_id, text), labels (doc_id, toxic)."""
    rng = random.Random(11)
    clean = [prose(rng, 60) for _ in range(40)]
    toxic = [f"{prose(rng, 30)} {' '.join(TOXIC)} {prose(rng, 30)}" for _ in range(30)]
    rows = [(100 + k, t) for k, t in enumerate(clean)] + [(200 + k, t) for k, t in enumerate(toxic)]
    labels = [(i, int(i >= 200)) for i, _ in rows]
    rows += [(1, None), (2, ""), (3, " \n\t"), (None, None), (None, "a row without an id and with words of its own"), (4, "short")]
    #: A toxic near copy with the smaller id goes first and so does not take the clean one with it.
    rows += [(10, f"{clean[0]} {' '.join(TOXIC)}")]
    #: Copies but for white space; of a copy without an id the other stays; repeated rows.
    rows += [(50, clean[1].replace(" ", "  ", 3)), (150, clean[2].replace(" ", "\n")), (None, clean[3]), (104, clean[4])]
    #: Near copies, one of a text that is a copy, and two that are linked by a third one only.
    chain = clean[7].split()
    rows += [(51, f"{clean[5]} one more"), (160, f"{clean[1]} tail"), (161, " ".join([*chain[6:], "p q r".upper()])), (162, " ".join([*chain[12:], *"p q r s t u".split()]))]
    #: Passages: cut from a long text, all of a short one, in a near copy, and one word too short.
    rows += [(170, f"{prose(rng, 40)} {PASSAGES[0].upper()}! {prose(rng, 40)}"), (171, f"so: {PASSAGES[1]}"), (172, PASSAGES[0]), (173, f"{prose(rng, 40)} {' '.join(PASSAGES[1].split()[:9])} {prose(rng, 5)}")]
    rows += [(174, f"{clean[8]} {PASSAGES[0]}"), (175, f"{clean[9]} {clean[10]} {clean[11]} {PASSAGES[1]}"), (176, f"{clean[9]} {clean[10]} {clean[11]} {PASSAGES[1]} end")]
    return rows, labels


def plain_near(rows):
    sets, comp = [plain_set(t, 5) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    least = {c: min((i for (i, _), own in zip(rows, comp) if own == c and i is not None), default=None) for c in comp}
    return [r for r, c in zip(rows, comp) if r[0] is None or r[0] == least[c]]


def plain_cut(rows):
    out = []
    for i, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        places, words, hit = [m.span() for m in re.finditer(LETTER, lowered)], words_of(text), set()
        for passage in PASSAGES:
            own = words_of(passage)
            for k in range(len(own) - 9):
                for a in range(len(words) - 9):
                    if words[a : a + 10] == own[k : k + 10]:
                        hit.update(range(a, a + 10))
        if 2 * len(hit) > len(words):
            continue
        out.append((i, text[: places[min(hit)][0]] + text[places[max(hit)][1] :] if hit else text))
    return out


def test_pipeline(spark, ranked):  # noqa: F811
    rows, labels = planted()
    where = shared_dir(spark, "pipeline-input")
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1 - t, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([*enumerate(PASSAGES), (9, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    left = [r for r in rows if TOXIC[0] not in (r[1] or "")]
    first = {}
    for i, t in left:
        if (k := spaced(t)) not in first or (i is not None and (first[k][0] is None or i < first[k][0])):
            first[k] = (i, t)
    near = plain_near(list(first.values()))
    cut = plain_cut(near)
    assert len(rows) > len(left) > len(first) > len(near) > len(cut)  # every stage has something to do
    want = Counter()
    for i, t in cut:
        ids = ranked.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)] += 1
    got = corpus_pipeline.run(spark, where).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect()
    assert Counter((*tuple(r)[:4], tuple(r["ids"])) for r in got) == want
