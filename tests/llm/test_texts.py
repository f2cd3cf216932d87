"""Line dedup, shingle joins, quality rules and the word arrays under them, against plain Python."""

import itertools
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from pyspark.sql import functions as F

from tidewheel.llm import components as components_
from tidewheel.llm import common, line_dedup, ngram_join, perplexity, surrogates, words
from tidewheel.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"


def test_words_and_shingles_are_told_apart_by_content():
    texts = ["a bc  d\te", "", None, "a bc d e", "é bc d e", "x"]
    got = {}
    for row, group in words.in_groups(pa.array(texts)):
        for i, h in zip(group.doc, group.words(), strict=True):
            got.setdefault(row + int(i), []).append(int(h))
    assert got[0] == got[3] and got[0][1:] == got[4][1:] and got[0][0] != got[4][0] and set(got) == {0, 3, 4, 5}
    sliced = pa.array(["zzz", *texts]).slice(1)
    assert [g.words().tolist() for _, g in words.in_groups(sliced)] == [g.words().tolist() for _, g in words.in_groups(pa.array(texts))]


def brute_dedup(rows, least=50):
    """rows: (id, text), in order of ids. Every run of whole lines that stands earlier goes if it has enough words."""
    count = lambda line: len(re.findall(WORD, line))
    docs = [[(i, line.strip(" "), count(line)) for i, line in enumerate(t.split("\n")) if count(line)] for _, t in rows]
    pairs = {}
    for d, lines in enumerate(docs):
        for p, (_, line, _) in enumerate(lines):
            pairs.setdefault(line, []).append((d, p))
    dead = [set() for _ in rows]
    for places in pairs.values():
        for (a, p), (b, q) in itertools.combinations(places, 2):
            i = j = 0
            while p - i > 0 and q - i > 0 and docs[a][p - i - 1][1] == docs[b][q - i - 1][1]:
                i += 1
            while p + j + 1 < len(docs[a]) and q + j + 1 < len(docs[b]) and docs[a][p + j + 1][1] == docs[b][q + j + 1][1]:
                j += 1
            run = docs[b][q - i : q + j + 1]
            if sum(n for *_, n in run) >= least:
                dead[b] |= set(range(run[0][0], run[-1][0] + 1))
    return {k: "\n".join(line for i, line in enumerate(t.split("\n")) if i not in gone) for (k, t), gone in zip(rows, dead, strict=True)}


def line(k, n=20):
    return " ".join(f"l{k}w{i}" for i in range(n))


def test_repeated_runs_of_lines(spark):
    rows = [
        (1, "\n".join(line(k) for k in (1, 2, 3, 4))),
        (2, "\n".join([line(9), line(2), "", line(3), line(4), line(8)])),  # a run over a blank line
        (3, "\n".join([line(3), line(4), line(7)])),  # 40 words: stays
        (4, "\n".join([line(5, 60), "own words here", line(5, 60)])),  # inside one document
        (5, line(5, 60)),
        (6, "\n".join([line(5, 60)] * 3)),
    ]
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_dedup(rows)
    assert got[5] == "" and got[4] == line(5, 60) + "\nown words here" and got[3] == rows[2][1]


def test_line_dedup_keeps_the_first_of_every_line(spark, docs):
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs, report=True).collect()}
    whole = brute_dedup(rows)
    assert {k: r.text for k, r in got.items()} == whole
    bare = lambda t: {x.strip(" ") for x in t.split("\n") if x.strip()}
    assert set().union(*(bare(t) for _, t in rows)) == set().union(*(bare(r.text) for r in got.values()))
    assert all(got[k].n_lines == len(t.split("\n")) and got[k].n_lines - got[k].n_removed <= len(got[k].text.split("\n")) for k, t in rows)


def test_odd_rows_pass_line_dedup(odd):
    got = line_dedup.drop_repeated_lines(odd)
    assert got.columns == odd.columns and sorted(map(str, got.collect())) == sorted(map(str, odd.collect()))
    assert line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0


def brute_links(rows, n=5, least=0.8):
    sets = {}
    for i, t in rows:
        w = re.findall(WORD, t or "")
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    links = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
    name = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    return {i: (name[i], sum(i in p for p in links)) for i in sets}


def test_classes_and_links(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = [f"v{i}" for i in range(60)]
    for k in range(40):  # near copies in a chain and around one text
        rows.append((1000 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])))
    rows += [(2000, "one two three"), (2001, "one two  three"), (2002, None), (2003, ""), (2004, " ".join(base)), (2005, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_groups(df).collect()}
    assert got == brute_links(rows)
    kept = sorted(r.doc_id for r in ngram_join.keep_first(df).collect())
    names = {c for c, _ in got.values()}
    assert set(kept) == names


def test_odd_rows_pass_the_join(odd):
    rows = ngram_join.similar_groups(odd).collect()
    assert len(rows) == odd.count() and {r.n_links for r in rows if r.doc_id == 4} == {1}
    kept = ngram_join.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert ngram_join.similar_groups(odd.limit(0)).count() == 0


def test_blocks_find_what_one_piece_finds(spark, monkeypatch):
    base, other = [f"v{i}" for i in range(80)], [f"u{i}" for i in range(90)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(40)] + [(100 + k, " ".join(other[k : k + 60])) for k in range(30)]  # a star and a chain
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 256


@pytest.mark.parametrize("local", [0, 100, 500_000])
def test_components_of_a_long_path(spark, monkeypatch, local):
    monkeypatch.setattr(components_, "LOCAL_EDGES", local)
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1100)]
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, got.values())) == [100, 201]


def brute_measures(t):
    w = re.findall(WORD, t or "")
    seen, covered = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2)), set()
    for k in range(len(w) - 2):
        if seen[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, docs, odd):
    for df in (docs, odd):
        texts = {(r.doc_id, r.text) for r in df.collect()}
        got = perplexity.judge(df).collect()
        assert len(got) == df.count()
        by = {}
        for r in got:
            by.setdefault(r.doc_id, set()).add((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words))
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
        assert all(brute_measures(t) in by[i] for i, t in texts)
    assert perplexity.judge(odd.limit(0)).count() == 0
    kept = perplexity.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == perplexity.judge(docs).where("kept").count()


def brute_levels(texts, order=3):
    """Interpolated modified Kneser-Ney over bytes, from the definition: counts, their discounts, and the probabilities of each order, lowest first."""
    counts = Counter(data[i - order : i] for t in texts for data in [b"\0" * (order - 1) + t] for i in range(order, len(data) + 1))
    levels = [counts]
    for _ in range(order - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))
    told = []
    for level in reversed(levels):
        n = [sum(c == k for c in level.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        cut = [0.0, *(max(0.05 * i, min(0.95 * i, i - (i + 1) * y * (n[i + 1] / n[i] if n[i] else 0.0))) for i in (1, 2, 3))]
        mates, probs = {}, {}
        for g, c in level.items():
            mates.setdefault(g[:-1], []).append(c)
        for g, c in level.items():
            total, lost = sum(mates[g[:-1]]), sum(cut[min(k, 3)] for k in mates[g[:-1]])
            probs[g] = (c - cut[min(c, 3)]) / total + lost / total * (told[-1][g[1:]] if told else 1 / 256)
        told.append(probs)
    return counts, cut, told


def brute_kneser_ney(texts, order=3):
    return brute_levels(texts, order)[2][-1]


def brute_log_ppl(texts, order, copies=None):
    """Of each text by letter, its own counts and its copies' left out of the highest order."""
    copies = copies or [texts.count(t) for t in texts]
    counts, cut, told = brute_levels(texts, order)
    followers = {}
    for g in counts:
        followers.setdefault(g[:-1], []).append(g)
    out = []
    for t, n in zip(texts, copies, strict=True):
        data = b"\0" * (order - 1) + t
        own = Counter(data[i - order : i] for i in range(order, len(data) + 1))
        left = lambda g: max(counts[g] - n * own[g], 0)  # noqa: E731, B023
        total = 0.0
        for g, times in own.items():
            every = sum(left(x) for x in followers[g[:-1]])
            lost = sum(cut[min(left(x), 3)] for x in followers[g[:-1]])
            q = told[-2][g[1:]]
            total -= times * np.log((left(g) - cut[min(left(g), 3)]) / every + lost / every * q if every else q)
        letters = sum(chr(c).isascii() and chr(c).isalnum() or c >= 128 for c in t)
        out.append(float(total / letters) if letters else np.inf)
    return out


def test_kneser_ney_by_its_definition(spark):
    texts = [b"abracadabra", b"abrakadabra simsalabim", b"cadabra"]
    order = 3
    counts = Counter(data[i - order : i] for t in texts for data in [b"\0" * (order - 1) + t] for i in range(order, len(data) + 1))
    table = spark.createDataFrame([("en", int.from_bytes(g, "big"), c) for g, c in counts.items()], "lang string, g long, n long")
    got = {r.g.to_bytes(order, "big"): r.p for r in perplexity.kneser_ney(table, order).collect()}
    want = brute_kneser_ney(texts, order)
    assert set(got) == set(want) and all(abs(got[g] - want[g]) < 1e-12 for g in want)


def test_counts_cover_all_texts(spark):
    got = {(r.lang, r.g): r.n for r in perplexity.count_grams(spark.createDataFrame([("en", "aab"), ("en", "aab"), ("de", "aab"), (None, None)], "lang string, text string")).collect()}
    assert sum(got.values()) == 9 and got["en", int.from_bytes(b"\0\0aab", "big")] == 2


def test_no_model_is_no_crash():
    texts = words.Texts(np.zeros(0, "u1"), np.array([0, 0]))
    assert perplexity.measure(texts)["n_words"].tolist() == [0]


def prose(rng, n, words=60):
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 7))) for _ in range(60)]
    return [" ".join(map(str, rng.choice(vocabulary, words))) for _ in range(n)]


def brute_quality(rows, reach=3.0, least=50):
    """rows: (id, text, lang), ids different. The ids that stay."""
    marks, log_ppl, good = {}, {}, []
    for i, t, _ in rows:
        (_, g), = words.in_groups(pa.array([t]))
        marks[i] = int(perplexity._mark(g.words(), g.doc, 1)[0])
    often = Counter(m for m in marks.values() if m)
    for lang in {x for *_, x in rows}:
        own = [(i, t or "") for i, t, x in rows if x == lang]
        values = brute_log_ppl([t.encode() for _, t in own], perplexity.ORDER, [often.get(marks[i], 1) for i, _ in own])
        log_ppl |= {i: v for (i, _), v in zip(own, values, strict=True)}
    for i, t, x in rows:
        n, *_, repeat = brute_measures(t)
        if n >= 50 and 100 * repeat <= 50 * n:
            good.append((i, x, n.bit_length() - 1))
    first = {}
    texts = {i: t for i, t, _ in rows}
    for i, x, size in sorted(good, key=lambda r: texts[r[0]]):  # of a group any counts; here groups are of equal texts
        first.setdefault((x, marks[i]), (x, size, round(log_ppl[i] * 10_000)))
    def fence(values):
        v = sorted(values)
        q1, q3 = (v[int(np.ceil(p * len(v))) - 1] / 10_000 for p in (0.25, 0.75))
        return q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)
    kept = set()
    for i, x, size in good:
        cells = {}
        for y, s, v in first.values():
            if y == x:
                cells.setdefault(s, []).append(v)
        full = {s: v for s, v in cells.items() if len(v) >= least}
        near = [s for s in sorted(full) if s <= size][-1:] or sorted(full)[:1]
        whole = [v for vs in cells.values() for v in vs]
        values = full[near[0]] if near else whole if len(whole) >= least else None
        low, high = fence(values) if values else (-np.inf, np.inf)
        if low <= log_ppl[i] <= high:
            kept.add(i)
    return kept


def test_perplexity_and_bands_by_their_definition(spark):
    rng = np.random.default_rng(3)
    texts = prose(rng, 40)
    for i in range(34, 38):  # more and more junk
        texts[i] = " ".join(w + "$$$" * (k % (39 - i) == 0) for k, w in enumerate(texts[i].split(" ")))
    texts[38], texts[39] = " ".join(["zz" * 10] * 25 + texts[38].split(" ")[:35]), "%%% " * 55
    texts += [texts[0]] * 3 + [texts[1]]
    log_ppl = brute_log_ppl([t.encode() for t in texts[:39] + texts[40:]], perplexity.ORDER)
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts) if i != 39], "doc_id int, text string, lang string")
    got = {r.doc_id: r for r in perplexity.judge(df, least=20).collect()}
    ids = [i for i in range(len(texts)) if i != 39]
    first = {}
    for i, x in zip(ids, log_ppl, strict=True):
        assert abs(got[i].log_ppl - x) < 1e-5
        if not got[i].base_failed:
            first[texts[i]] = round(x * 10_000)
    v = sorted(first.values())
    q1, q3 = (v[int(np.ceil(p * len(v))) - 1] / 10_000 for p in (0.25, 0.75))
    for i, x in zip(ids, log_ppl, strict=True):
        inside = q1 - 3 * (q3 - q1) <= x <= q3 + 3 * (q3 - q1)
        assert abs(got[i].lower - (q1 - 3 * (q3 - q1))) < 2e-4 and got[i].kept == (inside and not got[i].base_failed), (i, x)
    assert not any(got[i].kept for i in range(35, 38)) and all(got[i].kept for i in range(34)) and got[40].kept
    few = {r.doc_id: r for r in perplexity.judge(df, least=200).collect()}
    assert all(r.lower is None and r.kept != r.base_failed for r in few.values())


def test_junk_goes_and_clean_documents_stay(spark):
    """Labelled documents of sf0.01, with salad of letters planted."""
    rng = np.random.default_rng(11)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    salad = [(-1 - i, " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), rng.integers(3, 9))) for _ in range(400)), "en") for i in range(15)]
    got = {r.doc_id: r for r in perplexity.judge(docs.unionByName(spark.createDataFrame(salad, docs.schema))).where("not base_failed").collect()}
    good = [r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").collect() if r.doc_id in got]
    junk = [r for r in got.values() if 20 * r.n_symbols > r.word_chars]
    assert np.mean([got[i].kept for i in good]) >= 0.98
    assert np.mean([r.kept for r in junk]) <= 0.15 and not any(got[-1 - i].kept for i in range(15))


def test_ngrams_of_the_model_are_not_merged(spark, odd, docs):
    n = 40_000
    model = spark.createDataFrame([(lang, g, 1 + g % 1000, 0.5, 1 + g, 0.5, (1 + g) / n) for g in range(n // 2) for lang in ("en", "de")], "lang string, g long, n long, p double, all long, lost double, q double")
    table = common.settle(perplexity.hashed(model))
    parts = list(perplexity.slices(table, 5_000))
    keys = np.concatenate([t.key for t in parts])
    assert len(parts) == 8 and len(np.unique(keys)) == n
    for t in parts:
        at, there = t.find(t.key)
        assert there.all() and (t.key[at] == t.key).all() and not t.find(t.key + np.uint64(1))[1].any()
    assert sorted(np.concatenate([t.parts[3] for t in parts]).tolist()) == sorted(((1 + np.arange(n // 2)) / n).astype("f4").tolist() * 2)
    for df in (docs.limit(40).unionByName(docs.limit(3)), odd.select(docs.columns)):
        plain = df.selectExpr("doc_id AS id", "coalesce(lang, '') AS lang", "text")
        counts = common.settle(perplexity.count_grams(plain))
        cuts = {r["lang"]: [0.0, *r["cuts"]] for r in perplexity._discounts(counts).collect()}
        table, told = common.settle(perplexity.hashed(perplexity.kneser_ney(counts))), common.settle(perplexity.measured(plain))
        one, many = (perplexity.score(plain, told, table, cuts, size).collect() for size in (1 << 23, table.settled_rows // 3))
        order = lambda rows: sorted(rows, key=lambda r: (r.id or 0, r.n_words, r.lang))
        assert len(one) == len(many) == df.count()
        for a, b in zip(order(one), order(many), strict=True):
            assert a[:-1] == b[:-1] and (a.log_ppl is None) == (b.log_ppl is None) and abs((a.log_ppl or 0) - (b.log_ppl or 0)) < 1e-9


def test_small_groups_of_copies_count_whatever_the_size(spark):
    """Their sizes are told without regard to the number of rows, in any slices of groups and of the model."""
    rng = np.random.default_rng(7)
    texts = [x for i, x in enumerate(prose(rng, 12)) for _ in range(1 + i % 3)]
    plain = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "id long, lang string, text string")
    counts = common.settle(perplexity.count_grams(plain))
    cuts = {r["lang"]: [0.0, *r["cuts"]] for r in perplexity._discounts(counts).collect()}
    table, told = common.settle(perplexity.hashed(perplexity.kneser_ney(counts))), common.settle(perplexity.measured(plain))
    told.settled_rows = 10**9  # as if it had so many rows: groups of two and three were left out then
    parts = list(perplexity.group_slices(told, 3))
    assert len(parts) > 1 and sorted(n for g in parts for n in g.n.tolist()) == [2] * 4 + [3] * 4
    want = brute_log_ppl([t.encode() for t in texts], perplexity.ORDER, [texts.count(t) for t in texts])
    for size in (1 << 22, 3):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(perplexity, "slices", lambda model, _, f=perplexity.slices: f(model, 1 << 22))
            scored = {r.id: r.log_ppl for r in perplexity.score(plain, told, table, cuts, size).collect()}
        assert len(scored) == len(texts) and all(abs(scored[i] - x) < 1e-5 for i, x in enumerate(want))


def test_the_driver_holds_a_piece_of_a_slice_at_a_time(spark, monkeypatch):
    """A slice is broadcast in pieces and scored in one pass; scores are equal to the last bit in any pieces."""
    texts = [*prose(np.random.default_rng(11), 30, 200), "", None]
    plain = spark.createDataFrame([(i, "en" if i % 3 else "de", t) for i, t in enumerate(texts)], "id long, lang string, text string")
    counts = common.settle(perplexity.count_grams(plain))
    cuts = {r["lang"]: [0.0, *r["cuts"]] for r in perplexity._discounts(counts).collect()}
    table, told = common.settle(perplexity.hashed(perplexity.kneser_ney(counts))), common.settle(perplexity.measured(plain))
    rows, held, passes = table.settled_rows, [], []
    monkeypatch.setattr(perplexity, "_arranged", lambda got, *rest, f=perplexity._arranged: held.append(got.num_rows) or f(got, *rest))
    monkeypatch.setattr(perplexity, "_totals", lambda *a, f=perplexity._totals: passes.append(len(held)) or f(*a))
    found = []
    for piece in (1 << 22, rows // 6):
        monkeypatch.setattr(perplexity, "PIECE", piece)
        found.append({r.id: r.log_ppl for r in perplexity.score(plain, told, table, cuts, 2 * rows).collect()})
    assert held[0] == rows == sum(held[1:]) and len(held) == 9 and max(held[1:]) < rows // 6 and passes == [1, 9]
    assert found[0] == found[1] and len(found[0]) == len(texts)


def test_bounds_by_row_count_change_no_result(spark, monkeypatch):
    """All that hangs on row_count() picks a join or a number of slices: scores are equal to the last bit, and so are rows."""
    rng = np.random.default_rng(5)
    texts = [*prose(rng, 30, 200), *["same words"] * 3, None]
    plain = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "id long, lang string, text string")
    counts = common.settle(perplexity.count_grams(plain))
    cuts = {r["lang"]: [0.0, *r["cuts"]] for r in perplexity._discounts(counts).collect()}
    table, told = common.settle(perplexity.hashed(perplexity.kneser_ney(counts))), common.settle(perplexity.measured(plain))
    found = [{r.id: r.log_ppl for r in perplexity.score(plain, told, table, cuts, size).collect()} for size in (1 << 22, table.settled_rows // 3)]
    assert found[0] == found[1] and len(found[0]) == len(texts)
    gone = plain.where("id % 3 = 0").select("id", "text")
    kept = []
    for most in (common.MAX_KEYS, 0):
        monkeypatch.setattr(common, "MAX_KEYS", most)
        kept.append(sorted(r.id for r in common.drop_rows(plain, gone, [F.col("id"), F.col("text")]).collect()))
    assert kept[0] == kept[1] == [i for i in range(len(texts)) if i % 3]


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    texts = pa.array([" ".join("x" * int(k) for k in rng.integers(1, 40, 300)), "é" * 500 + " b\n\nc", "", "a b c d e f"])
    whole = [(g.words().tolist(), {k: v.tolist() for k, v in perplexity.measure(g).items()}, np.concatenate([*perplexity._grams(g), np.zeros(0, np.uint64)]).tolist()) for _, g in words.in_groups(texts)]
    monkeypatch.setattr(words, "BLOCK", 64)
    monkeypatch.setattr(perplexity, "BLOCK", 64)
    monkeypatch.setattr(words, "_powers", np.ones((2, 1), np.uint64))
    assert whole == [(g.words().tolist(), {k: v.tolist() for k, v in perplexity.measure(g).items()}, np.concatenate([*perplexity._grams(g), np.zeros(0, np.uint64)]).tolist()) for _, g in words.in_groups(texts)]


def test_a_text_of_50_mb_stays_within_bounds():
    """Measures, marks, n-grams and shingle sets of one very long text, whole."""
    word = np.random.default_rng(2).integers(97, 123, (50, 9), "u1")
    word[:, 8] = 32
    raw = word[np.random.default_rng(3).integers(0, 50, 5_600_000)].ravel()
    tracemalloc.start()
    (_, text), = words.in_groups(pa.array([raw.tobytes()], pa.large_binary()))
    told = perplexity.measure(text)
    seen = sum(int((counts := np.unique(code, return_counts=True))[1].sum()) for code in perplexity._grams(text))
    grams, _ = ngram_join.gram_sets(text, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told["n_words"].tolist() == [5_600_000] and told["word_chars"].tolist() == [8 * 5_600_000] and seen == len(raw) and len(grams) > 5_000_000
    assert peak < 1_200_000_000


CLASHES = ["_h", "_d", "_th", "_cuts", "_lines", "_found", "_odd", "_id", "_key", "_good", "id", "tw_0", "TW_1", "key", "hash", "cell", "total", "block"]


@pytest.mark.parametrize("op", [perplexity.keep_good, line_dedup.drop_repeated_lines, ngram_join.keep_first, lambda df: surrogates.replace_pii(df, "k")])
def test_columns_pass_through_whatever_they_are_called(spark, op):
    rows = [(i, line(i, 60), "en", *[f"{c}{i}" for c in CLASHES]) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    got = op(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(rows)


def test_the_pipeline_by_brute_force(spark, tmp_path):
    """Every stage of run() on a small table, against plain Python on what the stage before it kept."""
    import corpus_pipeline as c

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120")
    near = [f"n{i}" for i in range(80)]
    extra = [(1000, " ".join(near), "en"), (1001, " ".join(near[:-2] + ["x", "y"]), "en"), (1002, None, "en"), (1003, "%%% " * 60, "de"), (1004, "Mr John Smith of a@b.org " + " ".join(f"p{i}" for i in range(60)), "en")]
    now = docs.unionByName(spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in extra], docs.schema))
    for number, (name, stage) in enumerate(c.STAGES):
        before = now.collect()
        stage(spark, now, None).write.parquet(str(tmp_path / str(number)))
        now = spark.read.parquet(str(tmp_path / str(number)))
        after = now.collect()
        was, text = {r.doc_id: r.text for r in before}, {r.doc_id: r.text for r in after} if number < 4 else {}
        if name == "quality rules":
            assert set(text) == brute_quality([(r.doc_id, r.text, r.lang) for r in before]) and all(was[i] == t for i, t in text.items())
        elif name == "line dedup":
            assert text == brute_dedup(sorted(was.items()))
        elif name == "n-gram Jaccard join":
            blank = {}
            for i, t in sorted(was.items()):
                if not re.search(WORD, t):
                    blank.setdefault(t, i)
            worded = [(i, t) for i, t in sorted(was.items()) if re.search(WORD, t)]
            assert set(text) == {k for k, _ in brute_links(worded).values()} | set(blank.values()) and all(was[i] == t for i, t in text.items()) and 1000 in text and 1001 not in text
        elif name == "PII":
            assert set(text) == set(was) and "Smith" not in text[1004] and "a@b.org" not in text[1004] and text[1000] == was[1000]
            assert all(text[i] == t for i, t in was.items() if not re.search(r"[0-9@=:]|M[rs]|Dr|Sr|Herr|Frau|Miss|Sir|Prof|Señor|Mon|Mad|Mme|Mlle", t))
        else:
            lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            for r in after:
                ids = np.array([*lib.encode(was[r.doc_id], add_special_tokens=False).ids, 0], "<u4")[r.start : r.start + r.length]
                assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
            assert {r.doc_id for r in after if r.piece == 0} == set(was) and sum(r.length for r in after) == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in was.values())


def test_a_text_of_very_many_lines(spark):
    """Its time is in proportion: a frame from a line to the end would take hours."""
    lines = [f"line {i} of a long text with eleven words in it here" for i in range(100_000)]
    text = "\n".join(lines + ["new words between the parts"] + lines[5000:5010])
    df = spark.createDataFrame([(1, text, 0), (2, "\n".join(lines[:7]), 0)], "doc_id long, text string, `w``x` int")
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(df, report=True).collect()}
    assert got[1].text == "\n".join(lines + ["new words between the parts"]) and (got[1].n_lines, got[1].n_removed) == (100_011, 10)
    assert got[2].text == "" and got[2].n_removed == 7 and "w`x" in df.columns and got[2]["w`x"] == 0
