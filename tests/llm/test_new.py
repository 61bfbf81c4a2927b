"""Fill-in-the-middle, vector codes and decontamination against brute force, with nulls, ties, repeats, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import bpe, codes, infill, winnow

SCHEMA = "doc_id long, text string, lang string, id string, n long, form string, row long, items string, key string, part int"
BLANKS = "\x20\x09-\x0d"
TOKEN = re.compile(rf"[{BLANKS}]*[^{BLANKS}]+|[{BLANKS}]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    None, "", " \n\t ", "one", "a b", "  lead and trail \x0b\n", "é😀 中文 x y z \x1f w", "has <P> mark", "has <S>", "<M>", "<P S> < M> <<P", "q <\nP> r",
    "nul \x00 inside \x00\x00", "word " * 4000, "x" * 70_000, "tie tie tie tie", "tie tie tie tie",
]


def docs(spark, rows, parts=3):
    """rows: (id, text); the other columns clash with names that the operators use."""
    return spark.createDataFrame([(i, t, "en", "x", 5, "psm", 1, "y", "z", 9) for i, t in rows], SCHEMA).repartition(parts)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute_infill(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("slice_bytes", [infill.SLICE_BYTES, 64, 1])
def test_infill(spark, slice_bytes):
    rows = [(i * 31 + k, t) for k, t in enumerate(TEXTS) for i in range(12)] + [(None, "lost id here"), (4, "same id"), (4, "same id"), (-7, "below zero id")]
    table = docs(spark, rows)
    got = Counter(map(tuple, infill.fill_in_middle(table, slice_bytes=slice_bytes).collect()))
    want = Counter(brute_infill(i, t) for i, t in rows)
    assert got == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}
    digests = Counter(map(tuple, infill.fill_in_middle_digests(table, slice_bytes=slice_bytes).collect()))
    assert digests == Counter((*brute_infill(i, t)[:5], sha(brute_infill(i, t)[5]), sha(t or "")) for i, t in rows)


def test_infill_restores_every_text(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(["a", "<", ">", "P", "S", "M", " ", "\n", "é"]) for _ in range(r.randint(0, 60)))) for i in range(400)]
    made = infill.fill_in_middle(docs(spark, rows), rate=100, spm=50)
    back = {x.doc_id: x.text for x in infill.restore(made).collect()}
    assert back == dict(rows)


def test_infill_of_all_or_nothing_and_empty(spark):
    table = docs(spark, [(i, f"text number {i} of many") for i in range(50)])
    assert {x.form for x in infill.fill_in_middle(table, rate=0).collect()} == {"plain"}
    assert {x.form for x in infill.fill_in_middle(table, rate=100, spm=100).collect()} == {"spm"}
    assert {x.form for x in infill.fill_in_middle(table, rate=100, spm=0).collect()} == {"psm"}
    empty = infill.fill_in_middle(table.limit(0))
    assert empty.count() == 0 and infill.restore(empty).count() == 0 and infill.fill_in_middle_digests(table.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<double>, label int, x string, dim int, part int, row int, code string"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, k, "x", 1, 2, 3, "4") for i, v, k in rows], VECTORS).repartition(parts)


def brute_codes(rows, entries=256, rounds=4, parts=4):
    """By contract, one part at a time in Python integers; vectors of one length."""
    kept = [(i, [math.floor(1024 * x) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, kept[j][1]))
    width = len(kept[0][1]) // parts
    code, error, books = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        own = [v[p * width : (p + 1) * width] for _, v, _ in kept]
        book = [list(own[j]) for j in order[:entries]]
        apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        place = lambda: [min(range(len(book)), key=lambda e: (apart(v, book[e]), e)) for v in own]  # noqa: B023, E731
        for _ in range(rounds):
            at = place()
            for e in range(len(book)):
                mine = [own[j] for j in range(len(own)) if at[j] == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for j, e in enumerate(place()):
            code[j] += f"{e:02x}"
            error[j] += apart(own[j], book[e])
        books.append(book)
    labels = Counter()
    for (_, _, k), e in zip(kept, error, strict=True):
        labels[k] += e
    digest = sha(",".join(str(x) for book in books for entry in book for x in entry))
    return [(i, c, e, labels[k], digest) for (i, _, k), c, e in zip(kept, code, error, strict=True)], books


def draw(n, dim=8, seed=3, spread=0.6):
    r = random.Random(seed)
    return [(1000 - 3 * j, [round(r.uniform(-spread, spread), 2) for _ in range(dim)], r.choice([0, 1, 2, None])) for j in range(n)]


def result(made, spark):
    sums = codes.with_label_errors(made.codes).collect()
    return Counter((x.vec_id, x.code, x.error, x.label_error, made.sha256[x.dim]) for x in sums)


@pytest.mark.parametrize("entries", [256, 7, 1])
def test_codes(spark, entries):
    rows = draw(90)
    rows += [(5000 + i, rows[0][1], 1) for i in range(40)]  # a hot vector
    rows += [(7, rows[3][1], 0), (7, rows[4][1], 0), (None, rows[5][1], None), (None, [0.5] * 8, 2)]
    bad = [(1, None, 0), (2, [float("nan")] * 8, 0), (3, [0.1] * 7 + [None], 0), (4, [float("inf")] + [0.0] * 7, None)]
    want, books = brute_codes(rows, entries)
    made = codes.compress(vectors(spark, rows + bad), entries=entries)
    assert result(made, spark) == Counter(want)
    got = {(b.part, b.entry): b.components for b in made.books.collect()}
    assert got == {(p, e): v for p, book in enumerate(books) for e, v in enumerate(book)}


def test_codes_of_ties_negatives_and_large_numbers(spark):
    ties = [(i, [float(i % 3 - 1) / 1024] * 4 + [-0.5] * 4, i % 2) for i in range(60)]
    assert result(codes.compress(vectors(spark, ties), entries=5), spark) == Counter(brute_codes(ties, 5)[0])
    large = [(i, [v * 150_000 for v in x], k) for i, x, k in draw(50, seed=8)]
    assert result(codes.compress(vectors(spark, large), entries=9), spark) == Counter(brute_codes(large, 9)[0])


def test_codes_of_other_lengths(spark):
    a, b = draw(40, 8), [(i + 9000, v, k) for i, v, k in draw(30, 12, seed=6)]
    made = codes.compress(vectors(spark, [*a, *b, (3, [], 0), (4, [1e30, 0.1, 0.2, 0.3, 0.4], 0)]), entries=6)
    got = {x.vec_id: (x.code, x.error) for x in made.codes.collect()}
    for rows in (a, b):
        assert {i: got[i] for i, _, _ in rows} == {i: (c, e) for i, c, e, _, _ in brute_codes(rows, 6)[0]}
    assert got[3] == ("00000000", 0) and got[4] == ("00000000", 0)
    assert set(made.sha256) == {0, 5, 8, 12}


def test_codes_of_nothing(spark):
    made = codes.compress(vectors(spark, draw(5)).limit(0))
    assert codes.with_label_errors(made.codes).count() == 0 and made.books.count() == 0 and made.sha256 == {}
    assert codes.compress(vectors(spark, [(1, None, 0)])).codes.count() == 0


def test_decompressed_vectors_are_as_near_as_the_error_says(spark):
    rows = draw(70)
    made = codes.compress(vectors(spark, rows), entries=16)
    error = {x.vec_id: x.error for x in made.codes.collect()}
    back = {x.vec_id: x.vector for x in codes.decompress(made).collect()}
    assert len(back) == len(rows)
    for i, v, _ in rows:
        whole = np.floor(1024 * np.array(v))
        assert ((whole - 1024 * np.array(back[i])) ** 2).sum() == error[i]


def brute_leaks(rows, items, size=10):
    fold = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = fold(t)
        for a in range(max(0, len(w) - size) + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = fold(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                ids = windows.get(tuple(w[a : a + n]))
                if ids:
                    hit |= set(range(a, a + n))
                    found |= ids
        listed = sorted(str(i) for i in found if i is not None)
        spans = [(a, min(b for b in range(a, len(w) + 1) if b not in hit)) for a in sorted(hit) if a - 1 not in hit]
        out.append((d, len(w), len(hit), tuple(spans), tuple(listed), bool(hit)))
    return out


def leaks(spark, rows, items, **more):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, key string, window int").repartition(2)
    found = winnow.decontaminate(docs(spark, rows), table, **more)
    return Counter((x.doc_id, x.n_words, x.n_hit, tuple((s.start, s.stop) for s in x.spans), tuple(x["items"]), x.contaminated) for x in found.collect())


def corpus():
    r = random.Random(4)
    vocabulary = ["ab", "cd", "ef", "gh", "été", "中", "x1", "Zz"]
    text = lambda n: r.choice([" ", "-", ", "]).join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.randint(8, 30))) for i in range(40)]
    items += [(100, "the only one"), (101, "Solo"), (102, None), (103, "... !"), (104, items[0][1]), (None, text(14)), (0, text(12)), (9, items[1][1] + " tail words here")]
    rows = [(i, text(r.randint(0, 60))) for i in range(60)]
    for i in range(60, 120):
        words = re.split(r"[ ,-]+", items[r.randrange(40)][1])
        a, b = sorted(r.sample(range(len(words) + 1), 2))
        rows.append((i, f"{text(5)} {'_'.join(words[a:b]).upper()} {text(4)}"))
    rows += [(i, f"{text(3)} {items[2][1]} {text(2)}") for i in range(200, 240)]  # one item in many documents
    rows += [(300, None), (301, ""), (302, "?!"), (303, "THE only, ONE solo"), (304, "solo"), (305, "x" * 5000), (306, text(3000) + " " + items[3][1]), (7, "solo solo"), (7, "nothing"), (None, items[5][1]), (8, (items[48 - 3][1] + " ") * 3)]
    return rows, items


@pytest.mark.parametrize("more", [{}, {"gram": 1}, {"gram": 10}, {"field_bits": 16}, {"piece_bytes": 40}])
def test_leaks(spark, more):
    rows, items = corpus()
    assert leaks(spark, rows, items, **more) == Counter(brute_leaks(rows, items))


def test_leaks_by_a_shorter_window_and_full_bit_fields(spark, monkeypatch):
    rows, items = corpus()
    assert leaks(spark, rows, items, window=4, gram=2) == Counter(brute_leaks(rows, items, 4))
    monkeypatch.setattr(winnow, "_has", lambda field, h: np.ones(h.size, bool))  # all candidates travel; the join alone decides
    assert leaks(spark, rows[::3], items) == Counter(brute_leaks(rows[::3], items))


def test_leaks_of_empty_tables(spark):
    rows, items = corpus()
    assert leaks(spark, rows[:20], []) == Counter(brute_leaks(rows[:20], []))
    assert leaks(spark, [], items) == Counter()


def test_pieces_overlap():
    text = b"Alpha beta--gamma " + b"q" * 50 + b" delta eps zeta"
    words = text.translate(winnow.FOLD).split()
    for size in (1, 7, 30, 1000):
        got = {}
        for place, part in winnow._pieces(text, 2, size):
            for i, w in enumerate(part):
                assert got.setdefault(place + i, w) == w
        assert [got[i] for i in range(len(got))] == words


@pytest.mark.parametrize("long", [bpe.LONG, 3])
def test_long_words(monkeypatch, long):
    """Words encoded alone have the library's ids, and the time grows with their length only."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "LONG", long)
    path = bpe.default_tokenizer()
    official = Tokenizer.from_file(path)
    official.no_truncation(), official.no_padding()
    codec, r = bpe.Codec(bpe.load_model(path)), random.Random(8)
    draw = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = [draw("acgt", 3000), draw("abcdefghijklmnopqrstuvwxyzABCXYZ", 3000), draw("的一是不了人我在有", 2000), "a" * 2000, draw("=-_", 1500), draw("0123456789", 1500), "é" * 700, "short words here " + draw("xyz", 900) + " and " + draw("etaoin", 600), "a b c"]
    for t in texts:
        assert np.frombuffer(codec.encode(t)[0], np.int32).tolist() == official.encode(t, add_special_tokens=False).ids


def test_a_very_long_word_takes_seconds():
    codec, r = bpe.Codec(bpe.load_model(bpe.default_tokenizer())), random.Random(8)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400_000))
    began = time.process_time()
    ids = np.frombuffer(codec.encode(text)[0], np.int32).tolist()
    assert time.process_time() - began < 30 and codec.decode(ids) == text


def brute_stays(rows, alike):
    """Of each group of alike rows the one with the smallest id, null last, then the first one."""
    left, out = list(range(len(rows))), []
    while left:
        group, grown = {left[0]}, True
        while grown:
            more = {j for j in left if j not in group and any(alike(rows[i][1], rows[j][1]) for i in group)}
            grown = bool(more)
            group |= more
        out.append(min(rows[i][0] if rows[i][0] is not None else math.inf for i in group))
        left = [j for j in left if j not in group]
    return Counter(None if i == math.inf else i for i in out)


def test_stages_keep_columns_of_any_name(spark):
    """Null and repeated ids, equal and near texts, and columns named like the stages' own key."""
    import corpus_pipeline

    r = random.Random(3)
    base = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(60)) for _ in range(6)]
    near = [b.replace(b.split()[30], "changed", 1) for b in base[:3]]
    texts = [*base, *near, base[0], base[1], base[4], None, "", base[5], "short", "short"]
    ids = [9, 8, 7, 6, 5, 4, 30, 31, 2, 3, 1, None, 40, 41, 42, 4, 50]
    rows = list(zip(ids, texts, strict=True))
    table = spark.createDataFrame([(i, t, "en", f"s{k % 2}", 5, k, 7.5, "y") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, _row long, __ROW double, key string").repartition(3)
    exact = corpus_pipeline.exact(spark, table, "")
    kept = exact.collect()
    assert exact.columns == table.columns and all(x.text in (t for i, t in rows if i == x.doc_id) for x in kept)
    assert {x["_row"] for x in kept} <= set(range(len(rows))) and {x["__ROW"] for x in kept} == {7.5}
    assert Counter(x.doc_id for x in kept) == brute_stays(rows, lambda a, b: re.sub(f"[{BLANKS}]+", " ", a or "") == re.sub(f"[{BLANKS}]+", " ", b or ""))

    def alike(a, b):
        sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").split() for t in (a, b))]
        return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])

    close = corpus_pipeline.near(spark, table, "")
    assert close.columns == table.columns and Counter(x.doc_id for x in close.collect()) == brute_stays(rows, alike)
    mixed = corpus_pipeline.mix(spark, table, "")
    assert mixed.columns == table.columns and {x.doc_id for x in mixed.collect()} <= set(ids)
    coded = corpus_pipeline.tokens(spark, table, "").collect()
    assert Counter(x.doc_id for x in coded) == Counter(ids) and all(x.n_tokens == len(x.ids) for x in coded)
    judged = corpus_pipeline.quality(spark, table, "")
    assert judged.columns == table.columns
    for stage in (corpus_pipeline.exact, corpus_pipeline.near, corpus_pipeline.mix, corpus_pipeline.quality, corpus_pipeline.tokens):
        assert stage(spark, table.limit(0), "").count() == 0, stage


def test_language_states_are_read_for_many_texts_at_once():
    """The states that predictions read, feature by feature, are those that training computes, and stop with the text."""
    from tracewell.llm import langid

    r = np.random.default_rng(2)
    net = langid.Network(["a", "b", "c"])
    x, inside = r.integers(0, 256, (70, 33)).astype(np.uint8), (r.random((70, 33)) < 0.9).astype(np.float32)
    for d in "fb":
        assert np.allclose(net._read(x, d, inside).transpose(0, 2, 1), net._states(x, d, inside=inside), atol=1e-5)
    texts = [bytes(r.integers(32, 127, n).astype(np.uint8)) for n in (0, 1, 31, 191, 192, 193, 900)]
    for t, row in zip(texts, net.pooled(texts, 10_000, 32), strict=True):
        whole = net.positions(np.frombuffer(t, np.uint8)[:, None]).mean((0, 1)) if t else np.zeros(3)
        assert np.allclose(row, whole, atol=1e-5)


def test_near_stage_finds_close_copies_by_simhash(spark, monkeypatch):
    """With the bands taken away, copies within 4 bits of a fingerprint are still found, and the exact check still drops what is not similar."""
    from tracewell.llm import similar, simhash

    r = random.Random(12)
    base = [[f"w{r.randrange(10**6)}" for _ in range(400)] for _ in range(12)]
    texts = [" ".join(t) for t in base] + [" ".join([*t[:-1], "last"]) for t in base] + [None, ""]
    bits = [bin(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).count("1") for a, b in zip(texts[:12], texts[12:24], strict=True)]
    assert sum(b <= 4 for b in bits) >= 6
    monkeypatch.setattr(similar, "band_links", lambda rows, words=5: rows.select(rows.id.alias("a"), rows.id.alias("b")).limit(0))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in similar.similar_documents(table).collect()}
    assert got == {i: i for i in range(12)} | {12 + i: i if b <= 4 else 12 + i for i, b in enumerate(bits)} | {24: 24, 25: 24}
