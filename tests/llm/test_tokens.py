"""Byte BPE, token attribution and packing against the tokenizer libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import tokenizers

from tidewheel.llm import bin_slack, byte_bpe, token_counts

MULTI, PLAIN, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


def encoding(path):
    with open(path, "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(f), special_tokens={})


def odd_texts(n=4000):
    rng = random.Random(5)
    return ["", " ", "a\x1cb \x1c c", "a b c　 d", "it's  we'll 'S", "日本語 テスト 🙂🙂"] + ["".join(rng.choice("ab \n\t'sl1é日İΣ🙂\x1c\x85\xa0.,#Z") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_transducer_is_tiktoken_and_streams_back(docs):
    codec, lib = byte_bpe.codec(MULTI, public_tokenizers.PATTERN), encoding(MULTI)
    for text in odd_texts() + [r.text for r in docs.limit(60).collect()]:
        packed = codec.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == lib.encode_ordinary(text), repr(text)
        assert "".join(codec.decode(packed, 3)) == text


def test_full_tables_change_nothing(docs):
    with open(MULTI, "rb") as f:
        ranks = byte_bpe.read_ranks(f)
    small, lib = byte_bpe.Codec(ranks, public_tokenizers.PATTERN), encoding(MULTI)
    small.transducer.max_states, small.later.size = 50, 10
    for r in docs.limit(15).collect():
        assert np.frombuffer(small.encode(r.text), "<u4").tolist() == lib.encode_ordinary(r.text)


def test_utf8_stream_at_every_cut():
    data = "aé日🙂z".encode()
    for k in range(len(data) + 1):
        s = byte_bpe.Utf8Stream()
        assert s.feed(data[:k]) + s.feed(data[k:]) + s.close() == "aé日🙂z"
    s = byte_bpe.Utf8Stream()
    assert s.feed(b"a\xff\xf0\x9f") + s.close() == "a��"


def test_encoded_documents(odd):
    rows = byte_bpe.encode_documents(odd, MULTI, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows if r.doc_id in (1, 2)} == {(0, empty, empty)}
    assert all(len(r.ids) == r.n_tokens for r in rows)
    assert byte_bpe.encode_documents(odd.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_each_token_is_allocated_once(docs, rule):
    lib = encoding(PLAIN)
    some = docs.limit(40)
    sums, spans = {}, {}
    for r in token_counts.count_tokens(some, PLAIN, public_tokenizers.PATTERN, rule=rule).collect():
        sums[r.doc_id] = sums.get(r.doc_id, 0) + r.n_tokens
        spans.setdefault(r.doc_id, []).append((r.start_char, r.end_char))
    for r in some.collect():
        assert sums[r.doc_id] == pytest.approx(len(lib.encode_ordinary(r.text)))
        lines = [r.text[a:b] for a, b in sorted(spans[r.doc_id])]
        assert lines == r.text.splitlines(keepends=True) or "".join(lines) == r.text


def test_counts_of_each_line_by_plain_look(spark, docs, odd):
    """Tokens of the library, each given to the line of its first character."""
    lib = encoding(PLAIN)
    for df in (docs.limit(25), odd, odd.limit(0)):
        want = Counter()
        for r in df.collect():
            text = r.text or ""
            line_of = [0]
            for c in text:
                line_of.append(line_of[-1] + (c == "\n"))
            starts = [i for i, c in enumerate(text) for _ in c.encode()]  # the character of each byte
            at = 0
            for token in lib.encode_ordinary(text):
                want[r.doc_id, line_of[starts[at]]] += 1
                at += len(lib.decode_single_token_bytes(token))
        got = Counter()
        for r in token_counts.count_tokens(df, PLAIN, public_tokenizers.PATTERN).collect():
            got[r.doc_id, r.section] += r.n_tokens
        assert +got == want


def test_rules_at_a_boundary():
    a, b, s, e = (np.array(x) for x in ([0, 4, 9], [4, 9, 12], [0, 6, 10], [6, 8, 12]))
    for rule, want in {"start": [2, 0, 1], "majority": [2, 0, 1], "split": [1.5, 0.5, 1]}.items():
        counts, crossing = token_counts.allocate(a, b, s, e, rule)
        assert counts.tolist() == want and crossing.tolist() == [1, 1, 0]
    counts, _ = token_counts.allocate(np.array([5]), np.array([9]), np.array([0, 6]), np.array([6, 9]), "majority")
    assert counts.tolist() == [0, 1]
    counts, _ = token_counts.allocate(np.array([0]), np.array([2]), np.array([5]), np.array([6]))
    assert counts.tolist() == [0]


def test_sections_of_ones_own(spark):
    df = spark.createDataFrame([(1, "title words body words", [(0, 5), (12, 22)]), (2, None, None), (3, "x", [])], "doc_id long, text string, s array<struct<start:int,end:int>>")
    rows = token_counts.count_tokens(df, PLAIN, public_tokenizers.PATTERN, sections_col="s").orderBy("section").collect()
    assert [(r.doc_id, r.section, r.n_tokens) for r in rows] == [(1, 0, 1), (1, 1, 2)]


def test_word_ids_are_the_librarys():
    own, lib = bin_slack.WordTokenizer(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    texts = [*odd_texts(), "x <|endoftext|> a", "a<|endoftext|>b", " <|startoftext|>\n<|endoftext|>", "<|endof\ntext|> <|EndOfText|>", None, "word " * 3, "  lead", "trail  "]
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, begin = own.encode_all(pa.array(["cut off", *texts]).slice(1))
    for k, text in enumerate(texts):
        assert ids[begin[k] : begin[k + 1]].tolist() == want[k], repr(text)
    assert want[4004 + 2] == [343, 49407, 320]


def test_marks_are_not_learnt_with_each_word():
    """A mark after a letter is a word of its own, whatever mark; contractions, accents, digits and special tokens stay whole."""
    own, lib = bin_slack.WordTokenizer(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    texts = [f"word{m}{n} it's{m} {m}x{n}y don't{m}'ve O\u0301{m} a\u0301{m}\u0301 é{m}1a{m}É ÉCOLE{m}" for m in map(chr, range(33, 127)) for n in ("", "#", "'ll", "\u0338", "7")]
    special = [f"{t} b<|endoftext|>{t}" for t in texts]
    for some in (texts, special):
        ids, begin = own.encode_all(pa.array(some))
        for k, text in enumerate(some):
            assert ids[begin[k] : begin[k + 1]].tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)
    own = bin_slack.WordTokenizer(WORDS)
    own.encode("".join(f"word{m * n} " for m in "#*$%&!?;:-" for n in (1, 2, 3)))
    assert len(own.memo) == 31  # 31 words, not 30 spellings of one


def test_a_full_memo_and_small_blocks_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(bin_slack, "MEMO_SIZE", 50)
    monkeypatch.setattr(bin_slack, "AT_ONCE", 7)
    own, lib = bin_slack.WordTokenizer(WORDS), tokenizers.Tokenizer.from_file(WORDS)
    for r in docs.limit(10).collect():
        assert np.frombuffer(own.encode(r.text), "<u4").tolist() == lib.encode(r.text, add_special_tokens=False).ids


def check_packing(rows, texts, own):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for inside in by.values():
        at = 0
        for r in sorted(inside, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in texts:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        got = sorted(pieces[i], key=lambda r: r.piece)
        copies = len([r for r in got if r.piece == 0])
        assert sum(r.length for r in got) == copies * len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.start == 2048 * r.piece for r in got)
    return len(by)


def test_packed_documents(spark, docs, odd):
    own = tokenizers.Tokenizer.from_file(WORDS)
    for df in (docs, odd):
        rows = bin_slack.pack_documents(df, WORDS).collect()
        n = check_packing(rows, {(r.doc_id, r.text) for r in df.collect()}, own)
        assert n <= -(-sum(r.length for r in rows) // 2048) * 1.02
    assert bin_slack.pack_documents(odd.limit(0), WORDS).count() == 0


def best_sum(stock, room):
    sums = {0}
    for length, count in stock:
        sums = {s + k * length for s in sums for k in range(count + 1) if s + k * length <= room}
    return max(sums)


def test_fullest_is_the_best_there_is():
    rng = random.Random(3)
    for _ in range(200):
        stock = sorted({rng.randint(1, 60): rng.randint(1, 4) for _ in range(6)}.items(), reverse=True)
        room = rng.randint(1, 120)
        got = bin_slack.fullest(stock, room)
        assert sum(k * n for k, n in got.items()) == best_sum(stock, room) and all(n <= dict(stock)[k] for k, n in got.items())


def test_plan_places_each_length_as_often_as_it_occurs():
    counts = {2048: 5, 1500: 3, 548: 2, 10: 1000, 1: 7}
    slots, n = bin_slack.plan_bins(counts)
    ends = {}
    for i, (length, first, _, _) in enumerate(slots):
        times = (slots[i + 1][1] if i + 1 < len(slots) and slots[i + 1][0] == length else counts[int(length)]) - first
        ends[int(length)] = ends.get(int(length), 0) + times
    assert ends == counts and n == -(-sum(k * c for k, c in counts.items()) // 2048)
