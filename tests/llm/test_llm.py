"""The training-data operators against brute force on small fixtures, and on odd rows."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

pytest.importorskip("lorekeep.llm")
import public_tokenizers  # noqa: E402

from lorekeep.llm import base, blocks, bpe, decontaminate, learn, licenses, lines, minhash, neighbours, passages, quality, suffix, toxicity  # noqa: E402
from lorekeep.llm.graph import components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, n int, salt double, gone_id long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SPACED = re.compile("[^\x20\x09-\x0d]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def docs(spark, *texts, first=0):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [(first + i, t, "en", f"s{i % 2}", len(t or ""), "x", i, 0.5, -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def sentence(r, n, kinds=400):
    return " ".join(f"w{r.randrange(kinds)}" for _ in range(n))


def odd_texts():
    return [None, "", "   \n\t", "\x00\x00", "a", "É ß 你好 😀", "x" * 5000, "same words here", "same words here", ("long text " * 20000).strip()]


def classes(edges, ids):
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {i: root(i) for i in ids}


def test_license_scan(spark):
    texts = ["The MIT-License. mit license mit license", "SPDX-License-Identifier: (GPL-2.0 OR Apache-2.0) AND BSD-3-Clause", "GNU General Public License", "permit license", *odd_texts()]
    got = licenses.scan(docs(spark, *texts)).orderBy("doc_id").collect()
    phrases = licenses.BASE_PHRASES
    for r, t in zip(got, texts, strict=True):
        words = ALNUM.findall((t or "").translate(LOW))
        places = [(i, p) for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({phrases[p] for _, p in places})) and 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[1]["labels"] == "apache,bsd,gpl" and got[1]["score"] == 1.0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("SPDX License Identifier: Apache-2.0", "apache"), ("x\nspdx_license_identifier = MIT OR\nnext GPL-3.0", "mit"), ('"license-expression": "ISC and (MIT or BSD-2-Clause)"', "bsd,isc,mit"), ("SPDX-License-Identifier\nMIT", ""), ("the license expression of MIT", ""),
        ("é SPDX-License-Identifier: MIT\n# SPDX-License-Identifier: EPL-2.0", "epl,mit"), ("SPDX-License-Identifier: MIT AND OR", ""), ("SPDX-License-Identifier: (MIT OR", ""), ("SPDX-License-Identifier: MIT OR AND GPL-2.0", ""),
    ],
)
def test_tags_where_the_automaton_finds_them(text, labels):
    assert licenses.scan_text(text.encode())[5] == labels


@pytest.mark.parametrize(
    "text, value",
    [("MIT", 1.0), ("GPL-2.0 OR MIT", 1.0), ("GPL-2.0 AND MIT", 0.0), ("GPL-2.0 WITH Classpath-exception-2.0", 0.5), ("MIT AND (GPL-3.0 OR Apache-2.0)", 1.0), ("mit or gpl-2.0 and gpl-3.0", 1.0), ("AND MIT", None), ("(MIT", None), ("", None), ("unknown", None)],
)
def test_license_expressions(text, value):
    found = licenses.evaluate(text)
    assert (found and found[1]) == value


def test_line_dedup(spark):
    rows = [(i, f"http://{'Hot' if i < 12 else 'cold'}.example/{i}", f"<p>menu</p><p>own {i}</p><p>menu</p>" + ("<i>rare</i>" if i in (0, 12, 13) else ""), "clash") for i in range(20)] + [(20, None, None, ""), (20, "http://hot.example/", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r["page_id"], r["n_lines"]): (r["n_dropped"], r["text"]) for r in lines.clean_pages(pages).collect()}
    assert got[(0, 4)] == (2, "own 0\nrare") and got[(5, 3)] == (2, "own 5") and got[(12, 4)] == (2, "own 12\nrare") and got[(20, 0)] == (0, "")
    kept = lines.clean_documents(docs(spark, *(f"head\nbody {i}" for i in range(8)), None, "head"))
    assert kept.columns == DOCS.replace(",", "").split()[::2]
    texts = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert texts[0] == ("body 0", 6) and texts[8] == (None, 0) and texts[9] == ("", 0)


def brute_repeats(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        own = {raw[k : k + 50]: None for k in range(len(raw) - 49)}
        for k in range(len(raw) - 49):
            if raw[k : k + 50] in seen:
                gone[k : k + 50] = True
        seen |= set(own)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), int(gone.sum()), sum(1 for g, _ in itertools.groupby(gone) if g), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark):
    r = random.Random(4)
    shared = [sentence(r, 30) for _ in range(6)] + ["ab" * 60, "x" * 130]
    texts = []
    for _ in range(70):
        parts = [sentence(r, r.randrange(0, 25)) for _ in range(4)]
        texts.append(parts[0] + r.choice(shared)[r.randrange(0, 40) :] + parts[1] + (r.choice(shared) if r.random() < 0.5 else "") + parts[2])
    texts += [texts[0], texts[0], texts[1] + "é", *odd_texts()]
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix.digests(suffix.without_repeats(docs(spark, *texts))).collect()}
    assert got == brute_repeats(texts)


def test_suffix_order_and_common_prefixes():
    r = random.Random(2)
    blob, _ = suffix.join_texts([bytes(r.choice(b"ab\x00") for _ in range(r.randrange(60, 300))) for _ in range(8)] + [b"a" * 200])
    starts = np.array(sorted(r.sample(range(len(blob) - 50), 500)))
    words = suffix.first_eight(blob)
    order, rank = suffix.suffix_order(blob, words, starts)
    cut = [blob[i : i + 50].tobytes() for i in order]
    assert cut == sorted(cut) and sorted(order) == starts.tolist()
    assert [a == b for a, b in itertools.pairwise(cut)] == (rank[1:] == rank[:-1]).tolist()
    want = [0] + [next((k for k in range(50) if a[k] != b[k]), 50) for a, b in itertools.pairwise(cut)]
    assert suffix.common_prefixes(words, order).tolist() == want


def test_decontamination_in_one_block_and_in_several(spark):
    r = random.Random(5)
    items = [sentence(r, n, 60) for n in (3, 10, 25, 12, 12)] + ["", None, "é1 MIT"]
    texts = [sentence(r, 40, 60) + " " + (items[i % 5] or "") + "; " + sentence(r, 9, 60) for i in range(20)] + ["é1-mit", *odd_texts()]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words = lambda t: ALNUM.findall((t or "").translate(LOW))
    want = {}
    for i, t in enumerate(texts):
        own, hit, found = words(t), set(), []
        for k, item in enumerate(items):
            w = words(item)
            n = min(10, len(w))
            places = [s for j in range(max(1, len(w) - 9)) for s in range(len(own) - n + 1) if n and own[s : s + n] == w[j : j + n]]
            hit |= {s + d for s in places for d in range(n)}
            found += [str(k)] * bool(places)
        want[i] = (len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    for block in (decontaminate.BLOCK_BYTES, 200):
        got = {x["doc_id"]: tuple(x)[1:] for x in decontaminate.contamination(docs(spark, *texts), bench, block_bytes=block).collect()}
        assert got == want
    assert decontaminate.clean(docs(spark, *texts), bench).columns == DOCS.replace(",", "").split()[::2]


def test_decontamination_of_repeated_clashing_and_null_ids(spark):
    r = random.Random(15)
    items = [sentence(r, 12, 60) for _ in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"a b {items[0]}", f"a b {items[0]}", f"{items[1]} and {items[2]} x y z", "none of it", None]
    table = spark.createDataFrame([(d, t) for d in (7, None) for t in texts], "doc_id long, text string")
    rows = [sorted(map(str, map(tuple, decontaminate.contamination(table, bench, block_bytes=n).collect()))) for n in (decontaminate.BLOCK_BYTES, 200)]
    assert rows[0] == rows[1] and len(rows[1]) == 10
    whole = [tuple(x)[:4] for x in decontaminate.contamination(table, bench, block_bytes=200).filter("doc_id = 7").collect()]
    assert sorted(whole) == [(7, 0, 0, 0), (7, 3, 0, 0), (7, 14, 12, 1), (7, 14, 12, 1), (7, 28, 24, 2)]


def test_line_dedup_keeps_one_text_of_many_copies(spark):
    rows = ["head\nfirst of the copies\nsecond"] * 30 + [f"head\nbody {i}" for i in range(60)]
    got = {x["doc_id"]: x["text"] for x in lines.clean_documents(docs(spark, *rows)).collect()}
    assert all(got[i] == "first of the copies\nsecond" for i in range(30)) and all(got[30 + i] == f"body {i}" for i in range(60))


def test_paragraph_dedup(spark):
    r = random.Random(6)
    passage, near = sentence(r, 70, 10**6), sentence(r, 60, 10**6).split()
    edited = near[:30] + ["changed"] + near[31:]
    texts = [f"{sentence(r, 40, 10**6)} {p} {sentence(r, 40, 10**6)}" for p in (passage, passage, passage, " ".join(near), " ".join(edited))] + [sentence(r, 120), *odd_texts(), "one two three four five six", "One two three  four five six"]
    got = {x["doc_id"]: x for x in passages.without_repeats(docs(spark, *texts)).collect()}
    assert {i for i in got if got[i]["n_removed"]} == {1, 2, 4, len(texts) - 1}
    for i in (1, 2):
        assert got[i]["n_removed"] == len(passage) and set(got[i]["classes"]) & set(got[1]["classes"])
    assert got[4]["n_removed"] == len(" ".join(edited)) and got[len(texts) - 1]["kept"] == ""


def test_paragraph_dedup_against_brute_force(spark):
    """Every word of a passage of 51 words or more that a smaller document has must go, and no other word."""
    r = random.Random(16)
    shared = [sentence(r, r.randrange(51, 90), 100_000).split() for _ in range(40)]
    rows = []
    for _ in range(150):
        words = []
        for _ in range(2):
            words += sentence(r, r.randrange(0, 60), 100_000).split()
            part = r.choice(shared)
            words += [w if r.random() < 0.9 else w + "\n" for w in part] if r.random() < 0.7 else []
        rows.append(" ".join(words + sentence(r, 5, 100_000).split()))
    got = {x["doc_id"]: x["kept"] for x in passages.without_repeats(docs(spark, *rows)).collect()}
    seen, wanted, lost, wrong, alone = set(), 0, 0, 0, 0
    for i, text in enumerate(rows):
        words = text.split()
        again = set()
        for k in range(len(words) - 50):
            if tuple(words[k : k + 51]) in seen:
                again.update(range(k, k + 51))
        seen.update(tuple(words[k : k + 51]) for k in range(len(words) - 50))
        kept = got[i].split()
        unique_words = [w for k, w in enumerate(words) if k not in again]
        wanted += len(again)
        lost += max(0, len(kept) - len(unique_words))
        wrong += max(0, len(unique_words) - len(kept))
        alone += len(unique_words)
    assert wanted > 3000 and lost / wanted < 0.05 and wrong / alone < 0.01


def brute_groups(texts, n, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = SPACED.findall((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    of = classes(edges, sets)
    return {i: (len(sets[i]), of[i], of[i] == i) for i in sets}


def test_minhash_against_brute_force(spark):
    r = random.Random(7)
    base = [sentence(r, 60).split() for _ in range(4)]
    texts = []
    for i in range(48):
        w = list(base[i % 4])
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
        texts.append(" ".join(w))
    texts += ["Two words", "two  WORDS", *odd_texts()]
    got = {x["doc_id"]: tuple(x)[1:] for x in minhash.near_groups(docs(spark, *texts), 3, 85).collect()}
    assert got == brute_groups(texts, 3, 85)


def test_minhash_of_repeated_ids_and_by_either_join(spark, monkeypatch):
    texts = [(1, "a b c d e f"), (1, "x y z w v u"), (2, "x y z w v u q"), (3, "a b c d e f"), (1, "a b c d e f"), (5, "k l m n"), (None, "k l m n"), (6, None), (6, "k l m n")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted([(1, 4, 1), (1, 4, 1), (1, 4, 1), (2, 5, 1), (3, 4, 1), (5, 2, 5), (6, 0, 6), (6, 2, 5)])
    for most in (base.BROADCAST_IDS, 0):
        monkeypatch.setattr(base, "BROADCAST_IDS", most)
        assert sorted(tuple(x)[:3] for x in minhash.near_groups(table, 3, 75).collect()) == want
    assert [minhash.band_rows(p) for p in (80, 85)] == [6, 8]


def test_blocks_span_groups(monkeypatch):
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 30).astype(np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert blocks.intersections(sets, sets).astype(int).tolist() == want
    assert blocks.forest(4, np.array([0, 1, 0, 2]), np.array([1, 2, 2, 3])) == [0, 1, 3]


@pytest.mark.parametrize("n", [1, 2, 5000])
def test_components_of_a_shuffled_path_in_few_rounds(spark, n, monkeypatch):
    from lorekeep.llm import graph

    written = []
    monkeypatch.setattr(graph, "checkpointed", lambda df, *seen: written.append(1) or base.checkpointed(df, *seen))
    ids = random.Random(n).sample(range(3 * n), n)
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (-5, -5)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == ({i: min(ids) for i in ids} if n > 1 else {}) and len(written) <= 3 * 15


def test_components_of_stars_and_small_groups(spark):
    edges = [(1, 2), (2, 3), (3, 1), (2, 1), (10, 11), *((i, i + 1) for i in range(20, 40)), *((999_999, 1000 + i) for i in range(100_000))]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == classes(edges, {x for e in edges for x in e})


def labelled(r, n):
    for i in range(n):
        good, toxic = i % 4 != 0, i % 5 == 0
        text = (sentence(r, 60) if good else " ".join(f"{w}$$$" for w in sentence(r, 60).split())) + (" you idiot and stupid clown" if toxic else "")
        yield i, text, int(good), int(toxic)


def test_classifiers_on_held_out_rows(spark):
    r = random.Random(8)
    rows = list(labelled(r, 240))
    table = docs(spark, *(x[1] for x in rows), None, "  ")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows if i % 3] + [(1, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {x["doc_id"]: x["keep"] for x in quality.classify(table, labels).collect()}
    assert len(kept) == 242 and not kept[240] and not kept[241]
    held = [x for x in rows if x[0] % 3 == 0]
    assert np.mean([kept[i] == bool(q) for i, _, q, _ in held]) > 0.97
    toxic = {x["doc_id"]: x["toxic"] for x in toxicity.classify(table, labels).collect()}
    assert np.mean([toxic[i] == bool(t) for i, _, _, t in held]) > 0.97 and not toxic[240]
    assert quality.keep_good(table, labels).columns == DOCS.replace(",", "").split()[::2]


def test_classifiers_without_labels(spark):
    table = docs(spark, "some words", None, "x " * 20000)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x["doc_id"]: x["keep"] for x in quality.classify(table, labels).collect()} == {0: True, 1: False, 2: True}
    assert not any(x["toxic"] for x in toxicity.classify(table, labels).collect())
    one = spark.createDataFrame([(0, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(table, one).count() == 2 and not any(x["toxic"] for x in toxicity.classify(table, one).collect())
    assert learn.fit(np.zeros((3, 1)), np.ones(3)).predict(np.zeros((1, 1)))[0] > 0.5


def test_choice_of_words_and_sums_over_sure_documents_against_brute_force(spark):
    r = random.Random(18)
    rows = list(labelled(r, 120))
    table, labels = docs(spark, *(x[1] for x in rows)), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, quality int")
    words = learn.sample_words(quality.meta_columns(table), learn.labelled_ids(labels, "quality", 4000), learn.SPACED)
    sets = [set(learn.word_features(learn.Words([x[1].encode()], learn.SPACED))[1].tolist()) for x in rows]
    y = np.array([x[2] for x in rows])
    scores = {}
    for b in set().union(*sets):
        has = np.array([b in s for s in sets])
        if has.sum() >= 3:
            scores[b] = abs((has * y).sum() - has.sum() * y.mean()) / np.sqrt(has.sum() * y.mean() * (1 - y.mean()))
    want = sorted(sorted((b for b in scores if scores[b] >= 4), key=lambda b: (-scores[b], b))[:20])
    assert learn.choose(words, 20).tolist() == want
    feats = quality.features(table, np.array(want, dtype=np.int64))
    batch = feats.orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
    x = quality.views(batch)
    sure = {v: np.column_stack([np.append(m.weight / m.scale, m.bias - (m.weight / m.scale) @ m.mean) for m in [learn.fit(x[v], y.astype(float))] * 2]) for v in x}
    tried = {v: np.random.default_rng(1).standard_normal(w.shape) / 10 for v, w in sure.items()}
    got = quality.pass_over(feats.repartition(5), sure, tried)
    for v, other in (("text", "meta"), ("meta", "text")):
        for i in range(2):
            p = learn.sigmoid(x[other] @ sure[other][:-1, i] + sure[other][-1, i])
            q = learn.sigmoid(x[v] @ tried[v][:-1, i] + tried[v][-1, i])
            want = np.zeros(4 + 3 * x[v].shape[1])
            for row, a, b in zip(x[v], p, q, strict=True):
                if a >= quality.CONFIDENT or a <= 1 - quality.CONFIDENT:
                    label = float(a >= quality.CONFIDENT)
                    want += np.concatenate([[1, -np.log(b if label else 1 - b), b - label, b * (1 - b)], row * (b - label), row * b * (1 - b), row * row * b * (1 - b)])
            assert np.allclose(got[v, i], want) and want[0] > 0


def test_co_training_reaches_the_least_loss_and_leaves_folds_out(spark):
    r = np.random.default_rng(2)
    n, m = 90, 400
    clean = r.random(n + m) < 0.5
    text = np.column_stack([clean + 0.4 * r.standard_normal(n + m), r.standard_normal((n + m, 2))])
    meta = np.column_stack([clean + 0.5 * r.standard_normal(n + m), r.standard_normal(n + m)])
    x, free = {"text": text[:n], "meta": meta[:n]}, {"text": text[n:], "meta": meta[n:]}
    y, fold, taught = clean[:n].astype(float), np.arange(n) % quality.FOLDS, []

    def look(sure, tried):
        taught.append({v: w.copy() for v, w in sure.items()})
        return quality.sums_of(free, sure, tried)

    students = quality.co_trained(x, y, fold, look)
    last = taught[-1]
    for v, other in (("text", "meta"), ("meta", "text")):
        for i, s in enumerate(students[v]):
            rows = np.ones(n, bool) if i == 0 else fold != i - 1
            p = learn.sigmoid(free[other] @ last[other][:-1, i] + last[other][-1, i])
            sure = (p >= quality.CONFIDENT) | (p <= 1 - quality.CONFIDENT)
            weight = min(1.0, rows.sum() / sure.sum())
            z = np.column_stack([(np.vstack([x[v][rows], free[v][sure]]) - s.model.mean) / s.model.scale, np.ones(rows.sum() + sure.sum())])
            labels, weights = np.append(y[rows], p[sure] >= quality.CONFIDENT), np.append(np.ones(rows.sum()), np.full(sure.sum(), weight))
            w = np.append(s.model.weight, s.model.bias)
            slope = z.T @ (weights * (learn.sigmoid(z @ w) - labels)) + np.append(w[:-1], 0.0)
            assert np.abs(slope).max() < 0.05 * np.abs(z.T @ (weights * (0.5 - labels))).max()
    # What a fold's version learns doesn't follow from the fold's labels.
    other = y.copy()
    other[fold == 2] = 1 - other[fold == 2]
    again = quality.co_trained(x, other, fold, lambda sure, tried: quality.sums_of(free, sure, tried))
    assert np.allclose(again["text"][3].w, students["text"][3].w) and not np.allclose(again["text"][0].w, students["text"][0].w)
    one = quality.co_trained(x, np.ones(n), fold, lambda sure, tried: pytest.fail("one class alone teaches nothing"))
    assert (one["text"][0].model.weight == 0).all()


def test_kinds_of_toxic_words():
    x = np.array([[1, 1, 0, 0, 0], [1, 1, 0, 0, 1], [0, 0, 1, 1, 0], [0, 0, 1, 1, 1], [0, 0, 0, 0, 1], [0, 0, 0, 0, 1]], dtype=float)
    of = toxicity.kinds(x, np.array([1, 1, 1, 1, 0, 0]))
    assert of[0] == of[1] != of[2] == of[3] and of[4] == -1
    assert toxicity.kinds(x, np.zeros(6)).tolist() == [-1] * 5


def test_bpe_round_trip_and_ids(spark):
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(12)
    mixed = ["".join(r.choice(" \n\t\u00a0\u3000aé1.,'s你😀") for _ in range(r.randrange(1, 40))) for _ in range(400)]
    texts = ["Hello, world! it's 2024\n\n  x", "<|endoftext|>", "née 你好 😀 \x1c\x85 z", "aaaa" * 50, *mixed, *odd_texts()]
    for pieces in (bpe.TABLE_PIECES, 16):
        coded = bpe.encode(docs(spark, *texts), VOCABULARY, public_tokenizers.PATTERN, table_pieces=pieces)
        got = {x["doc_id"]: x for x in bpe.decode(coded, VOCABULARY).collect()}
        for i, t in enumerate(texts):
            want = library.encode_ordinary(t or "")
            assert got[i]["ids"] == want and bytes(got[i]["ids_bytes"]) == np.array(want, "<u4").tobytes()
            assert bytes(got[i]["decoded"]) == (t or "").encode() and got[i]["n_tokens"] == len(want)


def test_embedding_groups_against_brute_force(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((12, 8))
    rows = [(int(i), (base[i % 12] + 0.05 * r.standard_normal(8)).tolist(), int(i % 2), "x") for i in range(120)]
    rows += [(200, rows[0][1], 0, ""), (201, [2 * v for v in rows[0][1]], 0, ""), (202, None, 0, ""), (203, [0.0] * 8, 0, ""), (204, rows[0][1], None, ""), (205, [float("nan")] * 8, 0, ""), (206, [None] * 8, 0, ""), (207, [], 1, ""), (208, rows[1][1][:4], 1, "")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, salt string")
    good = {i: (np.array(v) / np.linalg.norm(v), lab) for i, v, lab, _ in rows if lab is not None and v and i not in (203, 205, 206, 208)}
    edges = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and float(good[a][0] @ good[b][0]) >= 0.98]
    of, links = classes(edges, [x[0] for x in rows]), {x[0]: 0 for x in rows}
    for e in edges:
        for i in e:
            links[i] += 1
    got = {x["vec_id"]: tuple(x)[1:] for x in neighbours.near_vectors(table).collect()}
    assert got == {i: (links[i], of[i], of[i] == i) for i in links}


def test_embedding_pairs_in_a_dense_label_are_all_found(spark):
    r = np.random.default_rng(5)
    unit = lambda m: m / np.linalg.norm(m, axis=-1, keepdims=True)
    centre = unit(r.standard_normal(64))
    m = unit(np.sqrt(0.9) * centre + np.sqrt(0.1) * unit(r.standard_normal((1500, 64))))
    m[1400:] = unit(m[:100] + 0.175 * unit(r.standard_normal((100, 64))))
    cos = m @ m.T
    edges = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cos >= 0.98, 1)), strict=True)]
    assert len(edges) >= 90
    of = classes(edges, range(1500))
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int")
    assert {x["vec_id"]: x["component_id"] for x in neighbours.near_vectors(table).collect()} == of


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for out in (
        licenses.scan(none), lines.clean_documents(none), decontaminate.contamination(none, bench), suffix.without_repeats(none), passages.without_repeats(none), minhash.near_groups(none, 5, 80), quality.classify(none, labels), toxicity.classify(none, labels),
        bpe.digests(bpe.encode(none, VOCABULARY, public_tokenizers.PATTERN), VOCABULARY), neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert out.count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline

    r = random.Random(9)
    rows = list(labelled(r, 120))
    leak = sentence(r, 14)
    table = [x[1] for x in rows] + [rows[1][1], sentence(r, 30) + " " + leak, None, ""]
    docs(spark, *table).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([x[:1] + x[2:] for x in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x["doc_id"]: x["decoded_sha256"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _, q, _ in rows if q}  # copy, leak, wordless and rejected documents are gone
    assert all(got[i] == hashlib.sha256(rows[i][1].encode()).hexdigest() for i in got)
