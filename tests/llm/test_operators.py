"""Operators against brute force, libraries and round trips, on texts with every edge case."""

import random
import re

import pytest

TEXT = "The quick brown fox jumps over the lazy dog while seven tall wizards quietly brew strong coffee at dawn near the old mill"
LONG = " ".join(f"word{n}" for n in range(4000))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "Delta", "eps", "zeta", "eta", "theta"]
    made = [(None, 10), ("", 11), (" \n\t ", 12), ("a", 13), (TEXT, 1), (TEXT, 2), (TEXT + " extra", 3), ("x" * 130, 4), ("xx" + TEXT[:80], 5), (LONG, 6), (LONG + " tail", 7), (TEXT.upper(), 8)]
    made += [(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), 100 + k) for k in range(40)]
    made += [(f"{TEXT}\n{k} own line {k * 7}\nshort\n{TEXT} again", 200 + k) for k in range(6)]
    return [(i, t, "clash", 1.5, len(t or "")) for t, i in made]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, batch string, score double, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def brute_suffix(rows):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g)
    return out


def test_suffix_dedup(docs, empty, rows):
    from spanforge.llm.suffix_dedup import remove_repeats

    assert {r.doc_id: bytes(r.kept) for r in remove_repeats(docs).collect()} == brute_suffix(rows)
    assert remove_repeats(empty).count() == 0


def test_suffix_dedup_of_frequent_strings(spark, monkeypatch):
    """Strings that most documents hold, between texts of their own: their hashes are frequent and split by the second hash."""
    from spanforge.llm import batches, suffix_dedup

    rng = random.Random(11)
    common = ["the conditions of this general licence ", "as described in the annual report of ", TEXT[:70]]
    texts = []
    for k in range(160):
        own = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(3, 90))) for _ in range(4)]
        texts.append((500 - k, "".join(o + rng.choice(common) for o in own), None))
    want = brute_suffix(texts)
    assert 20 < sum(len(want[i]) < len(t) for i, t, _ in texts) < 160
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    split = []
    for often in (2, 32, 10**9):
        monkeypatch.setattr(batches, "OFTEN", often)
        split.append({r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()})
    assert split == [want] * 3


def test_suffix_dedup_grows_with_the_input():
    """Strings that recur by chance bring no texts together, sorts are of bounded size, and batches times shards stay few."""
    import numpy as np

    from spanforge.llm import batches, suffix_dedup

    rng = random.Random(19)
    common, own = TEXT[:24], lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    left, right = ([(own(60) + common + own(60)).encode() for _ in range(50)] for _ in range(2))
    assert not set(suffix_dedup.segments(left)[3].tolist()) & set(suffix_dedup.segments(right)[3].tolist())
    keys, size = np.array([5, 3, 5, 9, 3, 7, 9, 9] * 500, np.uint32), np.full(4000, 100)
    keys[5::8] = 1000 + np.arange(500)  # keys of their own
    parts = suffix_dedup._shared(keys, size)
    assert sorted(np.concatenate(parts).tolist()) == np.flatnonzero(keys < 1000).tolist()
    assert len(parts) == 2 and all(not set(keys[a].tolist()) & set(keys[b].tolist()) for a, b in zip(parts, parts[1:], strict=False))
    assert suffix_dedup._shared(np.arange(5), np.full(5, 9)) == [] == suffix_dedup._shared(np.zeros(0, np.uint32), np.zeros(0, np.int64))
    assert [batches.batch_count(n) for n in (0, 820_000_000, 10**10, 10**12)] == [16, 205, 1024, 62_500]


def brute_components(texts):
    """{doc_id: (shingles, component)} by comparing every pair."""
    sets = {}
    for i, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("at_once", [3, 1 << 20])
def test_components(spark, monkeypatch, at_once):
    """Chains, a hub, loops, doubled and reversed edges, also where tasks contract few edges at once."""
    from spanforge.llm import components

    monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    rng = random.Random(at_once)
    chain = rng.sample(range(1000, 1200), 120)
    edges = list(zip(chain, chain[1:], strict=False)) + [(5000, k) for k in range(5001, 5150)] + [(7, 7), (8, 9), (9, 8), (8, 9), (-3, 4), (1 << 62, -(1 << 62))]
    edges += [(rng.randrange(9000, 9300), rng.randrange(9000, 9300)) for _ in range(140)]
    rng.shuffle(edges)
    root = {n: n for e in edges for n in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    try:
        got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
        assert len(got) == len(root) and all(r.component == find(r.node) for r in got)
        assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def test_jaccard(docs, empty, rows):
    from spanforge.llm.jaccard_join import near_duplicate_components

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicate_components(docs).collect()}
    assert got == brute_components([r[:2] for r in rows])
    assert near_duplicate_components(empty).count() == 0


@pytest.mark.parametrize("block", [2, 8, 1024])
def test_jaccard_of_long_chains(spark, monkeypatch, block):
    """Windows of one long text hang together in long chains, of which only neighbours link; groups above the block are taken apart by shingle."""
    from spanforge.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng, at, texts = random.Random(7), 0, []
    for k in range(90):
        at += rng.choice([1, 2, 4, 5, 9, 14])
        texts.append((1000 - k, " ".join(f"w{n}" for n in range(at, at + rng.choice([40, 44, 52])))))
    texts += [(2000 + k, texts[k][1] + f" end{k}") for k in range(0, 90, 3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = brute_components(texts)
    assert got == want
    assert 5 < len({c for _, c in want.values()}) < 90


def test_jaccard_moves_sets_of_many_near_copies_few_times(spark, monkeypatch):
    """A group of near copies well above the block shares most shingles; its sets must not move once for each."""
    from spanforge.llm import jaccard_join

    rng, texts, moved = random.Random(13), [], []
    for k in range(120):
        words = [f"w{n}" for n in range(150)]
        for _ in range(rng.choice([1, 2, 4, 5, 6])):
            words[rng.randrange(150)] = f"own{k}x{rng.random()}"
        texts.append((k, " ".join(words)))
    whole = jaccard_join.tile_links

    def links(tiled):
        moved.append(tiled.count())
        return whole(tiled)

    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "tile_links", links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    want = brute_components(texts)
    assert got == want
    assert 1 < len({c for _, c in want.values()}) < 120
    assert sum(moved) < 120 * 40


def test_jaccard_of_a_large_group_takes_few_tasks(spark, monkeypatch):
    """Each task leaves files and a row in Spark's log, so on many partitions rounds that few edges don't need fill the disk."""
    from spanforge.llm import components, jaccard_join

    rng, texts, rounds = random.Random(17), [], []
    for k in range(60):
        words = [f"w{n}" for n in range(100)]
        words[rng.randrange(100)] = words[rng.randrange(100)] = f"own{k}"
        texts.append((k, " ".join(words)))
    whole = components.checkpointed
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(components, "checkpointed", lambda df: rounds.append(1) or whole(df))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(kept, ("16", "false"), strict=True):
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few tasks", "")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(j).stageIds}
        tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    finally:
        spark.sparkContext.setJobGroup("other", "")
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == brute_components(texts)
    assert len(rounds) == 6 and 0 < tasks < 2500, (len(rounds), tasks)


def python_in_a_row(df):
    """Python operators at most that a task of this frame runs one above the other, each of which takes a worker of its own."""

    def of(node):
        below = [of(node.children().apply(k)) for k in range(node.children().size())]
        here, most = max((x for x, _ in below), default=0), max((x for _, x in below), default=0)
        if re.match("MapInArrow|FlatMap", node.nodeName()):
            here = 1 + here * (node.nodeName() == "MapInArrow")  # groups come by a shuffle
        elif not re.match("Project|Filter|Union|Repartition|SubqueryAlias", node.nodeName()):
            here = 0
        return here, max(here, most)

    return of(df._jdf.queryExecution().optimizedPlan())[1]


def test_jaccard_takes_one_python_worker_a_task(spark, monkeypatch):
    """Workers live on after a task with what they hold, so a second one in a task doubles what executors hold."""
    from spanforge.llm import components, jaccard_join

    rng, texts, found = random.Random(19), [], []
    for k in range(40):
        words = [f"w{n}" for n in range(100)]
        words[rng.randrange(100)] = words[rng.randrange(100)] = f"own{k}"
        texts.append((k, " ".join(words)))
    whole = components.checkpointed

    def seen(df):
        found.append(python_in_a_row(df))
        return whole(df)

    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    monkeypatch.setattr(components, "checkpointed", seen)
    monkeypatch.setattr(jaccard_join, "checkpointed", seen)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_components(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == brute_components(texts)
    assert max(found) == 1, found


def test_shingles_keep_little(monkeypatch):
    """What a worker keeps and needs at once is bounded, and sets don't depend on how texts are put together."""
    import tracemalloc

    from spanforge.llm import shingles

    rng = random.Random(23)
    texts = [" ".join(f"w{rng.randrange(50_000)}" for _ in range(n)) for n in [*[2000] * 150, 100_000, 0, 3]]
    monkeypatch.setattr(shingles, "_powers", type(shingles._powers)())
    tracemalloc.start()
    try:
        shingles.shingle_sets(texts[:150])
        kept, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 10e6 and most < 40e6, (kept, most)
    together = shingles.shingle_sets(texts)
    assert all((a == b).all() and a.size == b.size for a, b in zip(together, [shingles.shingle_sets([t])[0] for t in texts], strict=True))


def test_bpe_is_the_library(docs, empty, rows):
    import numpy as np
    from tokenizers import Tokenizer

    from spanforge.llm.bpe import encode_documents
    from spanforge.llm.common import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    texts = {i: t or "" for i, t, *_ in rows}
    for r in encode_documents(docs).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.text == texts[r.doc_id]
    assert encode_documents(empty).count() == 0


def test_bpe_odd_texts():
    import numpy as np
    from tokenizers import Tokenizer

    from spanforge.llm.bpe import PrefixEncoder
    from spanforge.llm.common import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.json")
    own, library, rng = PrefixEncoder(path), Tokenizer.from_file(path), random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice("abcdefgh    \n\n\t'sTRE0129!?.é漢字　ß\x1c\x85<|endoftext|>aaaa") for _ in range(rng.randint(0, 60)))
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)


def test_packing(docs, empty, rows):
    from tokenizers import Tokenizer

    from spanforge.llm.common import tokenizer_path
    from spanforge.llm.packing import WordTokens, pack_documents

    path = tokenizer_path("word_bpe_49k.json")
    library, own, rng = Tokenizer.from_file(path), WordTokens(path), random.Random(5)
    for _ in range(1500):
        t = "".join(rng.choice("ab \n'sT0!?.éÉ漢　​ßΣİ\x1c\x85\xa0́,.") for _ in range(rng.randint(0, 40)))
        assert own.encode(t) == b"".join(i.to_bytes(4, "little") for i in library.encode(t, add_special_tokens=False).ids)
    pieces = pack_documents(docs).collect()
    for i, t, *_ in rows:
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        n = len(library.encode(t or "", add_special_tokens=False).ids) + 1
        assert {p.doc_tokens for p in mine} == {n} and sum(p.length for p in mine) == n
        assert [p.start for p in mine] == [sum(q.length for q in mine[:k]) for k in range(len(mine))]
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own_pieces in by.values():
        at = 0
        for offset, length in sorted(own_pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_documents(empty).count() == 0


def test_packing_merges_each_pre_token_once():
    """Whatever its case and the marks at it, a word is merged once; ids over all plain Latin script are the library's."""
    from tokenizers import Tokenizer

    from spanforge.llm.common import tokenizer_path
    from spanforge.llm.packing import WordTokens

    path = tokenizer_path("word_bpe_49k.json")
    library, own, merged, rng = Tokenizer.from_file(path), WordTokens(path), [], random.Random(17)
    merge = own.pieces.merge
    own.pieces.merge = lambda raw: merged.append(raw) or merge(raw)
    own.encode("Thrandern thrandern, THRANDERN. thrandern*** (thrandern)\nthrandern")
    assert len([m for m in merged if b"thrandern" in m]) == 1
    for low, high in ((1, 0x80), (0x20, 0x250), (0xA1, 0x370)):
        for _ in range(400):
            text = "".join(chr(rng.choice([rng.randrange(low, high), rng.randrange(0x61, 0x7B), 0x20, 0x27, 0xB2, 0x130, 0x23A])) for _ in range(rng.randint(1, 40)))
            ids = library.encode(text, add_special_tokens=False).ids
            assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in ids), text


def test_first_fit_tree():
    from spanforge.llm.packing import FirstFit

    rng = random.Random(2)
    sizes = sorted((rng.randint(1, 50) for _ in range(300)), reverse=True)
    fit, bins = FirstFit(len(sizes), 100), []
    for n in sizes:
        k = next((k for k, used in enumerate(bins) if used + n <= 100), len(bins))
        if k == len(bins):
            bins.append(0)
        assert fit.put(n) == (k, bins[k])
        bins[k] += n


def brute_pii(t):
    from spanforge.llm.pii import luhn

    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 16, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == 3 or luhn(d)):
                out.append((kind, *m.span()))
    return out


def test_pii_base_spans_and_tagger(docs, empty):
    from spanforge.llm.pii import base_spans, find_personal_data, find_spans, redact, trained_tagger

    rng = random.Random(2)
    for _ in range(8000):
        t = "".join(rng.choice("ab@..--+ 0123456789012()%") for _ in range(rng.randint(0, 50)))
        assert base_spans(t) == brute_pii(t)
    w = dict(trained_tagger())
    t = "call (555) 123-4567 now or mail a.b@c.example.com, card 4111 1111 1111 1111 and v 3.2.0. thanks"
    base, every = find_spans(w, [t])[0]
    assert set(base) <= set(every) and base == brute_pii(t)
    assert "4111" not in redact(t, every) and "@" not in redact(t, every)
    assert find_spans(w, ["", "plain words only, 12 of them"]) == [([], []), ([], [])]
    assert find_personal_data(docs).count() == docs.count() and find_personal_data(empty).count() == 0


def test_tagger_on_held_out_windows():
    from spanforge.llm.pii import emissions, labelled_windows, trained_tagger, viterbi

    w = dict(trained_tagger())
    x, y = labelled_windows(200, 99)
    assert (viterbi(emissions(w, x)[0], w["trans"]) == y).mean() > 0.93


def test_tagger_decides_what_no_pattern_finds(spark):
    import numpy as np

    from spanforge.llm.pii import _writers, find_personal_data, find_spans, possible, trained_tagger, write_spans

    w = dict(trained_tagger())
    for text, span in (("mail bob (at) corp.org now", (0, 5, 22)), ("call (555) 123-4567 or come", (3, 5, 19))):
        assert find_spans(w, [text])[0] == ([], [span])
    for text in ("the cat is at the dot of noon", "on 2024-03-01 at 12:30:45", "version 3.2.0. and 15%", "id 123456789"):
        assert find_spans(w, [text])[0] == ([], [])
    assert not possible(1, "1.2.3.400") and not possible(2, "4111.1111.1111.1112") and possible(2, "4111.1111.1111.1111") and not possible(0, "stan. de")
    word, make, decoy = _writers(np.random.default_rng(123))
    rng, texts, gold = random.Random(4), [], []
    for _ in range(300):
        text, own = "", set()
        for _ in range(14):
            pick = rng.random()
            kind = rng.randrange(4)
            piece = make[kind]() if pick < 0.2 else decoy() if pick < 0.4 else word()
            if pick < 0.2:
                own.add((kind, len(text), len(text) + len(piece)))
            text += piece + rng.choice([" ", ", ", ".\n"])
        texts.append(text)
        gold.append(own)
    found, right, planted = 0, 0, 0
    for (base, every), own in zip(find_spans(w, texts), gold, strict=True):
        added = set(every) - set(base)
        own = {s for s in own if not any(a < s[2] and s[1] < b for _, a, b in base)}
        found, right, planted = found + len(added), right + len(added & own), planted + len(own)
    assert right >= 0.95 * found and right >= 0.5 * planted > 100
    # a window's place in a batch of texts doesn't matter, and the query's columns are those of the spans
    assert [x for t in texts[:40] for x in find_spans(w, [t])] == find_spans(w, texts[:40])
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts[:20], None, "", "9" * 100_000, "a@" * 20_000])] + [(None, texts[0])], "doc_id long, text string")
    rows = {r.doc_id: r for r in find_personal_data(df).collect()}
    assert len(rows) == 25
    for k, t in enumerate(texts[:20]):
        base, every = find_spans(w, [t])[0]
        assert base == brute_pii(t) and rows[k].base == write_spans(base) and rows[k].spans == write_spans(every)
        assert (rows[k].n_email, rows[k].n_phone) == (sum(s[0] == 0 for s in base), sum(s[0] == 3 for s in base))


def test_toxicity(spark, docs, empty):
    from spanforge.llm.toxicity import op4_toxicity, score_toxicity

    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = op4_toxicity(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in scored) >= 0.9 * len(scored)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.5 for r in score_toxicity(docs, none).collect())
    assert score_toxicity(empty, none).count() == 0


def test_restoring_noisy_words():
    import numpy as np

    from spanforge.llm.toxicity import CharacterModel, Restorer, letter_of_latin1

    letters, counts = letter_of_latin1(), np.zeros(27**3, np.int64)
    c = letters[np.frombuffer((" stupid idiot moron the and for with trash " * 50).encode(), np.uint8)].astype(int)
    np.add.at(counts, c[:-2] * 729 + c[1:-1] * 27 + c[2:], 1)
    restore = Restorer(CharacterModel(counts))
    for noisy, word in (("stup1d", "stupid"), ("m0r0n", "moron"), ("tr4sh", "trash"), ("stuuupid", "stupid"), ("i.d.i.o.t", "idiot")):
        assert word in restore[noisy]
    assert restore.spaced("you m o r o n there") == ["moron"]


def test_restoring_long_and_joined_texts():
    import numpy as np

    from spanforge.llm.toxicity import CharacterModel, Classifier, Restorer, Scorer, letter_of_latin1

    letters, counts = letter_of_latin1(), np.zeros(27**3, np.int64)
    c = letters[np.frombuffer((" stupid idiot moron the and for with trash you are such a " * 50).encode(), np.uint8)].astype(int)
    np.add.at(counts, c[:-2] * 729 + c[1:-1] * 27 + c[2:], 1)
    restore = Restorer(CharacterModel(counts))
    spelled = " ".join("youaresuchastupidforthewithandforthewithidiot")
    assert len(spelled) > 80 and "idiot" in restore.spaced(spelled) and {"stupid", "idiot"} <= {*restore.spaced("s t u p i d i d i o t")}
    assert "moron" in restore.spaced("t r a s h  m o r o n")
    assert "youaresuchastupidforthewithandforthewithidiot" in restore.spaced(spelled)
    for chunk in ("the,and;for/" * 10 + "idiot", "the,and;for/" * 10 + "1d1ot,the", "a=1&b=1d1ot", "idiot=the", "the!idiot", "\u6f22\u5b57" * 30 + "1d1ot", "y.o.u.s.t.u.p.i.d.i.d.i.o.t"):
        assert "idiot" in restore[chunk]
    score = Scorer(CharacterModel(counts), Classifier(["idiot"], np.array([-4.0, 8.0]))).score
    for text in ("the,and;for/" * 10 + "1d1ot", " ".join("thewithandforthewithandforthewithandforidiotyou"), "x " * 3 + "the and"):
        assert (score(text)[0] > 0.5) == ("the and" not in text)


def test_audio(docs, empty):
    from spanforge.llm.audio import MELS, WINDOW_FRAMES, audio_features, from_tensors, from_wave

    got = {r.doc_id: r for r in audio_features(docs).collect()}
    assert got[1].tensors == got[2].tensors and got[1].media == got[2].media
    for r in got.values():
        assert r.payload_bytes % 64 == 0 and r.payload_bytes > 0 and from_wave(r.media)[1] == r.payload
        t = from_tensors(r.tensors)
        assert t.schema.field("log_mel").type.shape == [WINDOW_FRAMES, MELS]
        assert all(a < b for a, b in zip(t["start_s"].to_pylist(), t["end_s"].to_pylist(), strict=True))
    assert bytes(got[10].payload) == bytes(64) and audio_features(empty).count() == 0


def test_resampling_matches_direct_filter():
    import numpy as np

    from spanforge.llm.audio import low_pass, resample

    x = np.random.default_rng(1).standard_normal(101).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        h = low_pass(up, down).T.reshape(-1)
        full = np.zeros(x.size * up)
        full[::up] = x
        want = np.convolve(full, h)[: x.size * up][::down]
        assert np.allclose(resample(x, up, down), want[: resample(x, up, down).size], atol=1e-4)


def brute_units(rows, least_words=1):
    """What op8 keeps of each (doc_id, text), by a plain reading of its rule."""
    from spanforge.llm.passages import WORD

    lines, windows, out = {}, {}, {}
    known = sorted({(i, t) for i, t in rows if i is not None and t}, key=lambda r: r[0])
    plain = lambda line: re.sub(r"[ \t\n\r\f\v]+", " ", line.lower()).strip(" ")
    for i, t in known:
        for n, line in enumerate(t.split("\n")):
            lines.setdefault(plain(line), (i, n))
        w = [x.lower() for x in WORD.findall(t)]
        for k in range(len(w) - 49):
            windows.setdefault(tuple(w[k : k + 50]), i)
    for i, t in known:
        gone, start = bytearray(len(t)), 0
        for n, line in enumerate(t.split("\n")):
            if len(WORD.findall(line)) >= least_words and lines[plain(line)] != (i, n):
                gone[start : start + len(line) + 1] = b"\1" * len(gone[start : start + len(line) + 1])
            start += len(line) + 1
        at = [m.span() for m in WORD.finditer(t)]
        hit = {k + n for k in range(len(at) - 49) if windows[tuple(t[a:b].lower() for a, b in at[k : k + 50])] < i for n in range(50)}
        for k in hit:
            a, b = at[k][0], at[k + 1][0] if k + 1 in hit else at[k][1]
            gone[a:b] = b"\1" * (b - a)
        out[i, t] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    return out


def test_line_dedup(docs, empty, rows):
    from spanforge.llm.line_dedup import dedup_units

    want = brute_units([(i, t) for i, t, *_ in rows])
    got = dedup_units(docs).collect()
    assert len(got) == len(rows) and all(r.kept == want.get((r.doc_id, r.text), r.text) for r in got)
    for r in got:
        left = list(r.text)
        for s in r.removed:
            left[s.start : s.start + s.length] = [""] * s.length
        assert "".join(left) == r.kept
    assert dedup_units(empty).count() == 0


@pytest.mark.parametrize("least_words", [1, 2, 8])
def test_short_lines(spark, least_words):
    """Lines of any length with a word in them are units; under a floor they go within paragraphs only."""
    from spanforge.llm.line_dedup import dedup_units, without_repeated_units

    of_eight = "one two three four five six seven eight"
    rows = [
        (1, "Hello\nhello \n\n--\nall  rights reserved\nthe end"), (2, "--\n\nALL rights\treserved\nown line\n--"), (3, "hello"), (4, "\n\n"), (5, of_eight + "\nHELLO\nown line of five"),
        (6, of_eight.upper() + "\nx"), (6, of_eight + "\ny"), (7, None), (None, "hello"), (8, "é\nÉ\ne"), (9, "hello\r\nthe end"), (9, "hello\r\nthe end"),
    ]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    want = brute_units(rows, least_words)
    got = dedup_units(df, least_words=least_words).collect()
    assert len(got) == len(rows) and all(r.kept == want.get((r.doc_id, r.text), r.text) for r in got)
    assert sum(r.kept != r.text for r in got) == {1: 9, 2: 5, 8: 2}[least_words]
    left = sorted((str(r.doc_id), r.text or "") for r in without_repeated_units(df, least_words).collect())
    assert left == sorted((str(i), want.get((i, t), t or "")) for i, t in rows)


def test_repeated_paragraphs(spark):
    from spanforge.llm.line_dedup import dedup_units, without_repeated_units

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    own = lambda n: " ".join(word() for _ in range(n))
    passage, short, signs = own(55), own(49), "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))
    in_lines = "\n".join(" ".join(passage.split()[k : k + 5]) for k in range(0, 55, 5))
    whole = own(80)
    rows = [
        (1, f"{own(30)} {passage} {own(9)}\n{own(4)}"), (2, f"{own(3)} {passage.upper()}, {own(8)}\n{own(60)}"), (3, f"{own(6)}\n{in_lines}\n{own(6)}"),
        (4, f"{own(20)} {short} {own(20)}"), (5, f"{own(9)} {short} {own(9)}"), (6, f"{own(9)}{signs}"), (7, f"{own(2)} {signs}.{own(60)}"), (8, f"{passage} {own(5)} {passage}"),
        (9, own(70)), (10, ""), (11, None), (12, whole), (13, whole), (14, whole.replace(" ", "\n")), (14, own(60)), (15, whole[:-7] + own(30)), (15, whole[:-7] + own(30)),
        (16, own(20) + " again " * 60), (None, whole), (17, whole + " " + signs), (17, whole + " " + signs),
    ]
    df = spark.createDataFrame([(i, t, len(t or ""), 1, 2) for i, t in rows], "doc_id long, text string, n_chars long, tag int, a int").repartition(3)
    want = brute_units(rows)
    got = dedup_units(df).collect()
    assert len(got) == len(rows) and all(r.kept == want.get((r.doc_id, r.text), r.text) for r in got)
    assert sum(len(r.kept) < len(r.text) for r in got) == 10
    left = sorted((str(r.doc_id), r.text or "", r.n_chars) for r in without_repeated_units(df).collect())
    assert left == sorted((str(i), k, len(k) if t is not None else None) for i, t in rows for k in [want.get((i, t), t or "")])
    assert without_repeated_units(df.where("false")).count() == 0


def test_warc(spark):
    from spanforge.llm.warc import build_derivatives, digest, read_record

    pages = spark.createDataFrame(
        [(1, "http://a.example/x y", "<html lang=en><title>T &amp; U</title><script>no</script><p>One<p>Two <a href='/z'>z</a>"), (2, None, None)], "page_id long, url string, html string"
    )
    got = build_derivatives(pages).collect()
    assert len(got) == 6
    response = {r.page_id: r.record_id for r in got if r.record_type == "response"}
    for r in got:
        fields, block = read_record(bytes(r.record))
        assert fields["WARC-Block-Digest"] == digest(block) and len(block) == r.content_length
        assert r.record_type == "response" or fields["WARC-Refers-To"] == response[r.page_id]
    text = next(bytes(r.record) for r in got if r.record_type == "conversion" and r.page_id == 1)
    assert read_record(text)[1].decode() == "One\nTwo z"


def test_warc_odd_pages(spark):
    import time

    from spanforge.llm.warc import build_derivatives, plain_text, read_record

    assert plain_text("<p>a<b") == "a<b" and plain_text("x<script>y") == "x" and plain_text("a<!-- b") == "a" and plain_text("<title>q") == "q"
    assert plain_text("<title a>t</title><title>u</title>z<nav>n</nav>q<style>s</style >w <script") == "z q w <script"
    began = time.time()
    for piece in ("<a", "<script", "<title>", "<html", "<!--", "<script>", "<a href ", "</script   "):
        plain_text(piece * 100_000 + ">"), plain_text(piece * 100_000)
    assert time.time() - began < 20
    rows = [(1, "u", "<html lang=en><title>T</title>" + "<p>x " * 50_000, "a", 1), (1, "u", "same", "b", 2), (1, "u", "same", "b", 2), (None, None, "", "c", None), (3, "", None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string, content_length long")
    got = build_derivatives(pages).collect()
    assert len(got) == 15 and all(len(read_record(bytes(r.record))[1]) == r.content_length for r in got)
    assert len({r.record_id for r in got}) == 12 and build_derivatives(pages.where("false")).count() == 0


def test_rows_of_one_id_and_null_ids(spark):
    from spanforge.llm.jaccard_join import near_duplicate_components, one_of_each
    from spanforge.llm.suffix_dedup import remove_repeats

    rng = random.Random(8)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d = own(60), own(60), own(60), own(60)
    rows = [(1, a), (1, b), (2, c), (2, a), (3, b + " more"), (4, c), (None, a), (None, None), (5, ""), (5, d), (5, d), (6, d + " end"), (7, None)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, digest string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in near_duplicate_components(df).collect())
    want = [(1, 56, 1), (1, 56, 1), (2, 56, 2), (2, 56, 1), (3, 57, 1), (4, 56, 2), (None, 56, None), (None, 0, None), (5, 0, 5), (5, 56, 5), (5, 56, 5), (6, 57, 5), (7, 0, 7)]
    assert got == sorted((str(i), n, str(k)) for i, n, k in want)
    left = sorted((str(r.doc_id), str(r.text)) for r in one_of_each(df).collect())
    assert [x for x in left if x[0] != "1"] == sorted((str(i), str(t)) for i, t in [(2, c), (None, a), (None, None), (5, ""), (5, d), (7, None)])
    assert [x for x in left if x[0] == "1"] == sorted([("1", a), ("1", b)])
    kept = sorted((str(r.doc_id), bytes(r.kept).decode()) for r in remove_repeats(df).collect())
    assert kept == sorted([("1", a), ("1", b), ("2", c), ("2", ""), ("3", " more"), ("4", ""), ("None", a), ("None", ""), ("5", ""), ("5", d), ("5", d), ("6", " end"), ("7", "")])


def test_wide_vectors_are_an_error(spark):
    from pyspark.sql import functions as F

    from spanforge.llm.hamming_search import top_k

    df = spark.createDataFrame([(i, [float(i)] * 96) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="dimensions"):
        top_k(df, F.col("vec_id") == 0).collect()


def test_hamming_search(spark):
    from pyspark.sql import functions as F

    from spanforge.llm.hamming_search import top_k

    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)], i) for i in range(60)]
    rows += [(100 + i, rows[3][1], 0) for i in range(30)] + [(None, rows[0][1], 0), (500, None, 0), (rows[5][0], rows[5][1], 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, distance int")
    got = {}
    for r in top_k(df, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.distance, r.vec_id)
    codes = {i: [x >= 0 for x in v] for i, v, _ in rows if i is not None and v is not None}
    for q in (i for i in codes if i % 10 == 0):
        want = sorted((sum(a != b for a, b in zip(codes[q], codes[o], strict=True)), o) for o in codes if o != q)[:5]
        assert [got[q][k + 1] for k in range(5)] == want
    assert top_k(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def brute_one_of_each(rows):
    """The (doc_id, text) that are the first of their near duplicates, by comparing all pairs of small tables."""
    sets, root = {}, {i: i for i, _ in rows}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(i, t) for i, t in rows if find(i) == i}


def test_pipeline_stages_and_run(spark):
    import corpus_pipeline
    from spanforge.llm.pii import find_spans, redact, trained_tagger
    from spanforge.llm.toxicity import score_toxicity

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    names, weights = docs.columns, dict(trained_tagger())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf).cache()
        assert out.columns == names and out.schema.simpleString() == docs.schema.simpleString()
        got = {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()}
        assert out.count() == len(got) > 0 and out.where("n_chars <> length(text)").isEmpty()
        if name == "toxicity":
            toxic = {r.doc_id for r in score_toxicity(docs, labels).where("score >= 0.5").collect()}
            want = {(i, t) for i, t in given if i not in toxic}
        elif name == "near_duplicates":
            want = brute_one_of_each(given)
        elif name == "repeated_lines":
            kept = brute_units(given)
            want = {(i, kept.get((i, t), t)) for i, t in given}
        else:
            want = {(i, redact(t, every)) for (i, t), (_, every) in zip(given, find_spans(weights, [t for _, t in given]), strict=True)}
        assert got == want
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()
    assert sorted(last) == sorted(corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, tag int, digest string, _may int"
    rows = [(1, None, "en", None, None, 1, "x", 0), (2, "", None, "s", 0, None, "y", 1), (3, "a", "en", "s", 1, 1, None, 2), (4, "word " * 30_000, "en", "s", 150_000, 1, "z", 3), (4, "word " * 30_000, "en", "s", 150_000, 1, "z", 3)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns
            kept = out.collect()
            assert [tuple(r) for r in kept if r.doc_id == 1] == given[:1]  # a null text stays null, whatever its length says
            docs = spark.createDataFrame(kept, schema)
        assert {r.doc_id for r in docs.collect()} == {r[0] for r in given}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() >= len({r[0] for r in given})
