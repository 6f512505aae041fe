"""The ten operators on small fixtures: nulls, empty tables, ties, repeats, clashing columns, and brute force."""

import collections
import hashlib
import random
import re

import pytest

from quire.llm import class_lm, decontaminate, exact_dedup, jaccard_join, language_id, mixing, suffix_dedup, token_count, toxicity, warc
from quire.llm.common import components, shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, id long, lane int, h long"
WORDS = ["".join(random.Random(i).choices("abcdefghilmnoprst", k=4)) for i in range(200)]


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choices(WORDS, k=n))


def rows():
    base = [text(i) for i in range(12)]
    near = base[0].split()
    out = [*base, base[1].upper(), base[1], " ".join([*near[:58], "new", "end"]), " ".join(["x", *near[1:]]), "", None, "   ", "a b", "A b", text(99, 3000), "q" * 5000, "123 !!"]
    full = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "fr", None if i % 7 == 0 else f"s{i % 3}", 0, 0.5, 1, 2, 3, 4) for i, t in enumerate(out)]
    return [*full, full[3], (None, "null id text", *full[0][2:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(t):
    return re.findall("[^\x20\x09-\x0d]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_exact(docs, none):
    got = exact_dedup.exact_groups(docs, "largest").collect()
    same = collections.defaultdict(list)
    lower = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    low = -(2**63)
    for r in rows():
        same[hashlib.sha256(lower(r[1]).encode()).hexdigest()].append(low if r[0] is None else r[0])
    assert len(got) == len(rows())
    for r in got:
        g = same[r.text_sha256]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))
    assert exact_dedup.exact_groups(none).isEmpty()
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_rows_go_by_identifier_and_text(spark):
    leak = "which of these three large rivers flows north through the whole old desert country before it meets the sea"
    full = [(1, text(1)), (5, text(1)), (5, text(2)), (7, text(3)), (7, text(3).upper()), (None, text(4)), (None, text(4)), (None, leak), (9, text(5)), (11, "x " + text(5)), (11, text(6)), (12, leak), (12, text(7))]
    d = spark.createDataFrame(full, "doc_id long, text string")
    left = sorted(((r.doc_id or 0, r.text.lower()) for r in exact_dedup.drop_copies(d).collect()))
    assert left == sorted({(i or 0, t.lower()) for i, t in full if (i, t) != (5, text(1)) and (i, t) != (12, leak)})
    near = {(r.doc_id, r.text) for r in jaccard_join.one_of_each(d).collect()}
    assert len(near & {(7, text(3)), (7, text(3).upper())}) == 1
    assert near - {(7, text(3)), (7, text(3).upper())} == {(i, t) for i, t in full if i != 7 and (i, t) not in {(5, text(1)), (11, "x " + text(5)), (12, leak)}}
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    clean = [(r.doc_id, r.text) for r in decontaminate.without_leaks(d, items).collect()]
    assert sorted(clean, key=str) == sorted(((i, t) for i, t in full if t != leak), key=str)


def test_merge_runs_across_batches():
    import pyarrow as pa

    part = lambda keys: pa.RecordBatch.from_pydict({"node": pa.array([0] * len(keys), pa.int32()), "digest": [bytes([k]) * 32 for k, _ in keys], "keep_id": [i for _, i in keys], "n": [1] * len(keys), "n_bytes": [5] * len(keys)})
    out = [r for b in exact_dedup.merge_runs(iter([part([(1, 9), (2, 8)]), part([(2, 3)]), part([(2, 4), (7, 1)])]), False) for r in b.to_pylist()]
    assert [(r["digest"][0], r["keep_id"], r["n"]) for r in out] == [(1, 9, 1), (2, 3, 3), (7, 1, 1)]


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows())
    by = collections.defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    whole = sum(r.size for r in got)
    assert abs(sum(x[0].target for x in by.values()) - whole) < 1e-6
    for x in by.values():
        assert x[0].source_size == sum(r.size for r in x) and sum(r.taken for r in x) == int(x[0].target)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(none).isEmpty()


def test_language(docs, none):
    model = language_id.fit(docs)
    got = language_id.predict(docs.select("doc_id", "text"), model).collect()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1
    assert language_id.fit(none)[0] == [] and language_id.predict(none.select("doc_id", "text"), model).isEmpty()
    assert language_id.known_language(docs).columns == docs.columns


def test_tokens(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    extra = ["Hello <|endoftext|> don't İstanbul ΑΣ 中文 é", "a" * 5000, ""]
    count = token_count.counter(public_tokenizers.path("word_bpe_49k.json"))
    assert [count.text(x) for x in extra] == [len(t.encode(x, add_special_tokens=False).ids) for x in extra]
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_count.count_tokens(docs).collect()) == want
    assert token_count.count_tokens(none).isEmpty()


def test_class_lm(docs, none):
    train = docs.where("doc_id < 15")
    model, counts = class_lm.fit(train)
    got = class_lm.score(docs.select("doc_id", "text"), model, counts).collect()
    c = collections.Counter(w for r in rows() if r[0] is not None and r[0] < 15 for w in [*tokens(r[1]), None])
    assert model.total == sum(c.values()) and model.types == len(c) and len(got) == len(rows())
    known = {r[0]: (len(tokens(r[1])) + 1, sum(w in c for w in [*tokens(r[1]), None])) for r in rows()}
    assert all((r.n_tokens, r.n_known) == known[r.doc_id] and r.score < 0 for r in got)
    m, k = class_lm.fit(none)
    assert class_lm.score(none.select("doc_id", "text"), m, k).isEmpty()


def test_class_lm_sums_to_one(docs):
    import numpy as np

    model, _ = class_lm.fit(docs)
    p = 10**model.move
    assert np.allclose(p.sum(1), 1)
    emit = np.bincount(model.of, 10**model.emit, class_lm.CLASSES)
    assert np.allclose(emit[np.unique(model.of)], 1)


def test_class_lm_places_words_beyond_the_most_frequent(spark):
    """Words of the tail get classes by their neighbours, also where their shape tells nothing."""
    import numpy as np

    r = random.Random(3)
    nouns, verbs = ([f"{k}{i}xx" for i in range(60)] for k in "nv")
    said = [f"the {n} runs" for n in nouns for _ in range(12)] + [f"they {v} it" for v in verbs for _ in range(12)] + ["the nxx runs"] * 2
    said += [t for i in range(10) for t in (f"the often{i} runs", f"they usual{i} it") for _ in range(60)]
    r.shuffle(said)
    data = [(i, t) for i, t in enumerate([*said, *(" ".join(r.sample([f"f{k}" for k in range(2100)], 2100)) for _ in range(40))])]
    d = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    model, counts = class_lm.fit(d)
    assert len(model.of) > class_lm.UNITS + 120 and model.lexicon.unit.max() == len(model.of) - 1
    p, emit = 10**model.move, np.bincount(model.of, 10**model.emit, class_lm.CLASSES)
    assert np.allclose(p.sum(1), 1) and np.allclose(emit[np.unique(model.of)], 1)
    # under classes that tell the two apart, each tail word goes to the class of its like
    ids = lambda ws: class_lm.word_ids(np.frombuffer(" ".join(ws).encode(), np.uint8), np.array([0, len(" ".join(ws))]))[0]
    top = counts.orderBy("n", ascending=False).toArrow()
    lexicon = class_lm.Lexicon(top["h"].to_numpy().copy(), top["n"].to_numpy().copy())
    of = np.full(class_lm.UNITS, 7)
    of[class_lm.END_UNIT] = 0
    for k, ws in enumerate([["the"], ["runs"], [f"often{i}" for i in range(10)], ["they"], ["it"], [f"usual{i}" for i in range(10)]]):
        of[lexicon.find(ids(ws))[2]] = k + 1
    one = np.eye(class_lm.CLASSES)[of]
    h, c = class_lm.placed(d, lexicon, of, one.T @ class_lm.unit_bigrams(d, lexicon) @ one)
    got = dict(zip(h.tolist(), c.tolist(), strict=True))
    assert [got[x] for x in ids(nouns).tolist()] == [3] * 60 and [got[x] for x in ids(verbs).tolist()] == [6] * 60
    assert not set(ids(["nxx", "the"]).tolist()) & set(got)


def jaccard(width, percent):
    s = {}
    for r in rows():
        w = tokens(r[1])
        s[r[0] if r[0] is not None else -(2**63)] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    up = {i: i for i in s}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in s:
        for j in s:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard(docs, none, width, percent):
    got = jaccard_join.similar(docs, width, percent).collect()
    want = jaccard(width, percent)
    assert len(got) == len(rows()) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    if width == 5:
        assert jaccard_join.similar(none).isEmpty()


def test_jaccard_lists(spark):
    """Documents that share passages in many ways, linked or not, against all pairs."""
    r = random.Random(8)
    passages = [r.choices(WORDS, k=r.randint(8, 40)) for _ in range(14)]
    data = [(i, " ".join(w for p in r.sample(passages, r.randint(1, 4)) for w in (p if r.random() < 0.7 else [*p[:-2], f"e{i}", *p[-2:]]))) for i in range(260)]
    sets = {}
    for i, t in data:
        w = tokens(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    up = dict(zip(sets, sets, strict=True))
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((up[i], up[j]))
                up = {k: a if v == b else v for k, v in up.items()}
    got = jaccard_join.similar(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: x.component_id for x in got} == up and 20 < len(set(up.values())) < 250


@pytest.mark.parametrize("before", [1, 8])
def test_jaccard_families(spark, monkeypatch, before):
    """Long documents of one mould, whose words vary each by itself, so that each pair shares many lists, against all pairs."""
    monkeypatch.setattr(jaccard_join, "BEFORE", before)
    r = random.Random(4)
    mould = [f"m{i}" for i in range(900)]
    data = [(i, " ".join(w if r.random() > (0.004, 0.015, 0.02, 0.04)[i % 4] else w + r.choice("xy") for w in mould)) for i in range(48)]
    data += [(60, data[1][1]), (61, data[1][1].replace("m7 ", "m7z ")), (61, data[2][1].replace("m9 ", "m9z "))]
    sets = {(i, t): frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in data}
    up = {i: i for i, _ in data}
    for (i, t), x in sets.items():
        for (j, u), y in sets.items():
            if (i, t) < (j, u) and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((up[i], up[j]))
                up = {k: a if v == b else v for k, v in up.items()}
    got = jaccard_join.similar(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert {(x.doc_id, x.component_id) for x in got} == set(up.items()) and 10 < len(set(up.values())) < 45


def test_jaccard_chain(spark):
    """A chain of documents each near the next only, and hub copies: all one component."""
    w = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(w[i * 4 : i * 4 + 200])) for i in range(20)]
    got = jaccard_join.similar(spark.createDataFrame(chain, "doc_id long, text string"), 4, 85).collect()
    assert {r.component_id for r in got} == {0}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 9)] + [(20, 30), (30, 25)], "a long, b long")
    assert dict(components(links).collect()) == {**{i: 1 for i in range(1, 10)}, 20: 20, 25: 20, 30: 20}


def repeats(data):
    """Brute force: (doc_id, text) in order, each a document: n_bytes, n_removed, n_spans, kept_sha256."""
    seen, want = set(), []
    for i, t in data:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(b[p : p + 100])
        spans = sum(g and not h for g, h in zip(gone, [False, *gone], strict=False))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return want


@pytest.mark.parametrize("limit", [1, 4, 1024])
def test_suffixes(spark, none, monkeypatch, limit):
    """Whatever the number of contexts beyond which anchors, and zones, are dealt over shards."""
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", limit)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    r = random.Random(1)
    passage = "".join(r.choices("abcdefgh ", k=230))
    data = [(i, "".join(r.choices("ab", k=r.randint(0, 120))) + passage[(k := r.randint(0, 100)) : k + r.randint(90, 230)] + "é" * r.randint(0, 130)) for i in range(60)]
    data += [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 101), (105, "y" * 250)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == repeats(data)
    if limit == 1:
        assert suffix_dedup.remove_repeats(none).isEmpty()


def test_suffixes_of_zones_alone(spark, monkeypatch):
    """Zones that share no key with others, and contexts of anchors that are not cut into zones, pass no join over zones."""
    monkeypatch.setattr(suffix_dedup, "SHARD_CONTEXTS", 4)
    part, met = suffix_dedup.parted, []
    monkeypatch.setattr(suffix_dedup, "parted", lambda df, *a: met.append(df.count()) or part(df, *a))
    r = random.Random(2)
    some = lambda k: "".join(r.choices("abcdefgh ", k=k))
    passage, both = some(90), some(150)
    data = [(i, some(90) + passage + some(90)) for i in range(200)]  # no window of 100 bytes is shared
    data += [(200 + i, some(20) + both + some(20)) for i in range(2)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == (want := repeats(data))
    assert sum(x[2] for x in want) >= 150 and sum(met) < 200


def test_suffixes_of_rows_without_identifiers_of_their_own(spark):
    """Rows of a null or repeated identifier keep what only they have; rows repeated whole lose the same."""
    both = text(7, 40)
    data = [(None, text(1, 40)), (None, both + " " + text(2, 40)), (3, both), (3, text(3, 40)), (3, text(3, 40)), (9, text(1, 40) + text(4, 40))]
    d = spark.createDataFrame([(*x, 1.0, "k") for x in data], "doc_id long, text string, start double, key string")
    got = sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup.remove_repeats(d).collect())
    by = lambda x: (x[0] if x[0] is not None else -1, hashlib.sha256(x[1].encode()).digest())
    want = repeats(sorted(set(data), key=by))
    want += [x for x, y in zip(want, sorted(set(data), key=by), strict=True) if y == data[3]]
    assert got == sorted(x[1:] for x in want)


def test_leaks(spark, docs, none):
    item = "A train leaves Boston at 9 with 120 people and reaches the old harbour of Dover after 45 minutes of slow travel in the rain"
    again = item.replace("120", "77").replace("45", "31").replace("Dover", "Calais")
    mixed = "the train of rain and slow travel with 45 people leaves"
    d = spark.createDataFrame([(1, "x y z " + item + " end"), (2, "Then a " + again[2:]), (3, mixed), (4, None), (5, ""), (None, item), (1, "x y z " + item + " end")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "short one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.leaks(d, items).collect()}
    assert got == {(1, 7): True, (2, 7): False, (-(2**63), 7): True}
    assert decontaminate.leaks(docs, items).isEmpty() and decontaminate.leaks(none, items).isEmpty()
    clash = decontaminate.without_leaks(docs, items)
    assert clash.columns == docs.columns and clash.count() == len(rows())


def test_leaks_of_items_that_start_with_names(spark):
    tom = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"
    items = [(1, tom), (2, "Anna reads twelve pages of her new book daily"), (3, "Сначала старый поезд везёт Ивана через лес домой к его Марии"), (4, "Who discovered penicillin first")]
    bob = tom.replace("Tom", "Bob").replace("5", "7").replace("3", "4")
    found = [(1, 1, bob), (2, 1, "Well then. " + bob + " Yes."), (3, 2, "Zoe reads 31 pages of her new book daily"), (4, 3, items[2][1].replace("Ивана", "Петра").replace("Марии", "Ольге")), (5, 4, "They asked: who discovered penicillin first")]
    clean = [(11, bob.replace("Bob have", "Sue have").replace("Bob buys", "Kim buys")), (12, "Fleming discovered penicillin first"), (13, "Zoe reads pages of her new book daily")]
    d = spark.createDataFrame([*((i, t) for i, _, t in found), *clean], "doc_id long, text string")
    got = decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.exact) for r in got) == [(1, 1, False), (2, 1, False), (3, 2, False), (4, 3, False), (5, 4, True)]


def test_leaks_without_windows(spark):
    """Items of few template tokens leak where their words and numbers stand as they are."""
    items = [(1, "Compute 17 * 23 + 45 - 6"), (2, "Solve 2x + 3y"), (3, " ".join(map(str, range(40)))), (4, "Add 5 km, 7 km, 9 km, 11 km and 13 km")]
    d = [(10 * i + 1, f"So: {t.lower()}. Done") for i, t in items] + [(12, "Compute 17 * 23 + 45 - 7"), (22, "Solve 2x + 4y"), (32, " ".join(map(str, range(39)))), (42, "5 km 7 km 9 km 11 km and 13 km")]
    got = decontaminate.leaks(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.exact, r.n_matched == r.n_windows) for r in got) == [(10 * i + 1, i, True, True) for i in (1, 2, 3, 4)]


def test_toxicity(spark, none):
    clean = [(i, text(i), 0) for i in range(60)]
    toxic = [(100 + i, text(i + 500) + " you idiot and moron " + text(i + 900, 9), 1) for i in range(30)]
    model = toxicity.fit(spark.createDataFrame([*clean, *toxic, (500, "unlabelled", None)], "doc_id long, text string, toxic int"))
    assert [model.channel.decode(w) for w in ("1d1ot", "m.0.r.0.n", "idiiiot")] == ["idiot", "moron", "idiot"]
    d = spark.createDataFrame([(1, "such an 1d1ot and m0r0n"), (2, text(1)), (3, None), (4, "i d i o t and moron")], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(d, model).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1}
    empty = toxicity.fit(none.selectExpr("doc_id", "text", "cast(null as int) as toxic"))
    assert toxicity.score(none.select("doc_id", "text"), empty).isEmpty()


def test_trigrams_of_all_texts(spark, monkeypatch):
    """The decoder's model counts unlabelled texts and those beyond the sample, however rows are dealt."""
    monkeypatch.setattr(toxicity, "SAMPLE", 5)
    full = [*((i, text(i), i % 2) for i in range(40)), (90, None, 1), *((100 + i, "Zyx  qwv zyx", None) for i in range(20))]
    d = spark.createDataFrame(full, "doc_id long, text string, toxic int")
    want = collections.Counter()
    for _, t, _ in full:
        w = "  " + "  ".join(tokens(t)) + "  "
        want.update(g for k in range(len(w) - 2) if (g := w[k : k + 3]).strip())
    got = [{g: n for g, n in toxicity.trigrams(d.repartition(k)).items() if g.strip()} for k in (1, 7)]
    assert got == [want, want]
    channel = toxicity.fit(d).channel
    assert {"zyx", "yx ", "qwv"} <= set(channel.logs) and channel.decode("zy><x") == "zyx"


def test_spelled_out(spark, monkeypatch):
    clean = [(i, text(i), 0) for i in range(60)]
    toxic = [(100 + i, f"{text(i + 500)} {('idiot', 'loser', 'imbécile', 'ass')[i % 4]} {text(i + 900, 9)}", 1) for i in range(80)]
    plain = [(200 + i, "you are and i am a fine one " + text(i + 700), 0) for i in range(30)]
    model = toxicity.fit(spark.createDataFrame([*clean, *toxic, *plain], "doc_id long, text string, toxic int"))
    spell = lambda t, gap=" ": gap.join(t.replace(" ", ""))
    bad = ["you are a l o s e r", "y o u i d i o t", "such an a s s", "i m b é c i l e", "y o u   a s s", spell(text(5, 40) + " idiot " + text(6, 40)), "x" + "".join(text(7, 30).split()) + "-1d1ot-" + "".join(text(8, 30).split())]
    good = ["you are a f i n e one", spell(text(5, 40)), "c l i m b", "i  a m", "x" + "".join(text(7, 60).split()) + "-1"]
    got = {r.doc_id: r.predicted for r in toxicity.score(spark.createDataFrame(list(enumerate([*bad, *good])), "doc_id long, text string"), model).collect()}
    assert [got[i] for i in range(len(bad) + len(good))] == [1] * len(bad) + [0] * len(good)
    long = ["".join(text(9, 100).split()).replace("a", "4").replace("i", "1"), "q1" * 400, "x.." * 99]
    whole = [model.channel._decode(t, spaced) for t in long for spaced in (True, False)]
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert [model.channel._decode(t, spaced) for t in long for spaced in (True, False)] == whole


def test_warc(spark):
    path = shared_dir(spark)
    pages = [(1, "u", None, 0), (2, None, "", 0), (None, "x", "é", 0), (4, "a\r\nb", "é", 0), (5, "z", "WARC/1.1\r\n\r\n" * 30000, 0)]
    warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string, size int"), path)
    got = {r.record_id[len("<urn:quire:page:") : -1]: r for r in warc.archived(spark, path).collect()}
    assert {k: (r.record_type, r.payload_bytes) for k, r in got.items()} == {"1": ("response", 0), "2": ("revisit", 0), str(-(2**63)): ("response", 2), "4": ("revisit", 2), "5": ("response", 360000)}
    assert bytes(got["5"].payload).decode() == pages[4][2] and got["5"].payload_digest == warc.base32_sha1(pages[4][2].encode())
    few = warc.archived(spark, path, payload=False).where("record_type = 'revisit'")
    assert few.count() == 2 and few.where("payload is not null").isEmpty()


@pytest.mark.parametrize("packed", ["whole", "each", "plain"])
def test_warc_of_others(tmp_path, packed):
    """Archives without lengths in their members: one member for all records, one for each, and none."""
    import gzip
    import io

    each = [b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(t), t) for i, t in enumerate([b"", b"a\r\n\r\nb", b"x" * 200000, b"WARC/1.0\r\n\r\n", b"\r\n"])]
    data = {"whole": gzip.compress(b"".join(each)), "each": b"".join(map(gzip.compress, each)), "plain": b"".join(each)}[packed]
    got = list(warc.records(io.BytesIO(data), [], True))
    assert [(r[0], r[6], r[7]) for r in got] == [("<0>", 0, b""), ("<1>", 6, b"a\r\n\r\nb"), ("<2>", 200000, b"x" * 200000), ("<3>", 12, b"WARC/1.0\r\n\r\n"), ("<4>", 2, b"\r\n")]
    assert [r[0] for r in warc.records(io.BytesIO(data), [lambda h: h["warc-record-id"] in ("<1>", "<4>")], False)] == ["<1>", "<4>"]


def test_warc_of_an_empty_table_and_repeated_rows(spark):
    path = shared_dir(spark)
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.archived(spark, path).isEmpty()
    path = shared_dir(spark)
    warc.archive(spark.createDataFrame([(1, "u", "abc"), (1, "u", "abc"), (2, "u", "abc"), (3, "u", ""), (4, "u", "")], "page_id long, url string, html string"), path, least=1)
    got = sorted((r.record_id, r.record_type) for r in warc.archived(spark, path).collect())
    assert [t for _, t in got] == ["response", "response", "revisit", "response", "response"]


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert got and len({r.doc_id for r in got}) == len(got)


