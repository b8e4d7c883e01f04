"""Alignment, token files and fill-in-middle beside plain versions, with odd documents."""

import hashlib
import heapq
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from usagelens.llm import alignment as A
from usagelens.llm import byte_tokens, queries
from usagelens.llm import fill_middle as M
from usagelens.llm import token_files as T
from usagelens.session import scratch_path

SPECIAL = [(30, "x <|endoftext|> y"), (31, "<s> </s> <unk> <0x0A>"), (32, "aaaaaaaaaaaaaaaaaaaaaaaaa" * 40), (33, "▁ marker"), (34, "\U0001F600\U0001F600é́ zürich"),
           (35, "has <P> mark"), (36, "ends with <"), (37, "a b c \x85 d"), (30, "x <|endoftext|> y")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def many(spark, odd, texts):
    """The odd documents and some with special strings: (rows, frame)."""
    more = spark.createDataFrame(SPECIAL, "doc_id long, text string")
    return texts + SPECIAL, odd.unionByName(more, allowMissingColumns=True)


# ---------------------------------------------------------------- fill-in-middle
def plain_fill(i, text):
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    n, digest = len(units), sha(f"42:{'' if i is None else i}")
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return i, n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("size", [1, 7, M.PIECE])
def test_fill_middle(many, size):
    rows, frame = many
    cut = M.pieces(frame.filter("length(text) < 5000 or text is null") if size < 9 else frame, size=size)
    wanted = [plain_fill(i, t) for i, t in rows if size > 9 or len(t or "") < 5000]
    assert {w[2] for w in wanted} == {"plain", "psm", "spm"}
    got = [tuple(r) for r in M.digests(cut).collect()]
    texts = {sha(w[5]): t or "" for w, t in zip(wanted, [t for _, t in rows if size > 9 or len(t or "") < 5000])}
    assert Counter(got) == Counter((*w[:5], sha(w[5]), sha(texts[sha(w[5])])) for w in wanted)
    assert Counter(tuple(r) for r in M.texts(cut).collect()) == Counter(wanted)


def test_fill_middle_of_nothing(none):
    assert M.digests(M.pieces(none)).collect() == [] and M.texts(M.pieces(none)).collect() == []


def test_every_document_can_be_transformed(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5)) for i in range(200)], "doc_id long, text string")
    got = M.digests(M.pieces(docs, rate=100, spm_rate=0)).collect()
    assert {r.form for r in got if r.doc_id % 5} == {"psm"} and all(r.restored_sha256 == sha("w " * (r.doc_id % 5)) for r in got)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n\x0b  é", max_size=30))
def test_units(text):
    raw = text.encode()
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    ends = M.unit_ends(raw).tolist()
    assert [raw[a:b].decode() for a, b in zip([0, *ends], ends)] == units


# ------------------------------------------------------------------ token files
def least_cost(counts):
    """Cost of Huffman's own codes, without a limit."""
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=2, max_size=60))
def test_code_lengths(counts):
    counts = np.array(counts)
    free, tight = T.code_lengths(counts, 25), T.code_lengths(counts, 6)
    assert sum(2.0 ** -free.astype(float)) == 1 == sum(2.0 ** -tight.astype(float)) and tight.max() <= 6
    assert int((counts * free).sum()) == least_cost(counts) <= int((counts * tight).sum())


def test_code_lengths_with_a_limit_are_the_least():
    counts = [1, 1, 2, 3, 5, 8, 13]
    def best(left, room):  # all ways to give each id 1 to 4 bits
        if not left:
            return 0 if room >= 0 else 10**9
        return min((left[0] * k + best(left[1:], room - 2 ** (4 - k)) for k in range(1, 5) if room >= 2 ** (4 - k)), default=10**9)
    assert int((np.array(counts) * T.code_lengths(np.array(counts), 4)).sum()) == best(counts, 16)
    assert T.code_lengths(np.array([7])).tolist() == [1] and T.code_lengths(np.array([], dtype=int)).tolist() == []
    with pytest.raises(ValueError):
        T.code_lengths(np.ones(9, dtype=int), 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(1, 50))
def test_codes_round_trip(values, step):
    ids = np.array(values, dtype=np.int32)
    seen = np.unique(ids)
    codes = T.Codes.of_lengths(seen, T.code_lengths(np.bincount(ids)[seen] if len(ids) else np.array([], dtype=int)))
    payload, marks = T.pack(ids, *codes.encoder(), step)
    sizes = np.array([min(step, len(ids) - at) for at in range(0, len(ids), step)], dtype=np.int64)
    assert T.unpack(payload, marks, sizes, *codes.decoder(), codes.limit).tolist() == values


def plain_tokens(rows):
    """(doc_id, start, ids) in the order of ids, null last; rows of one id in any order."""
    library = Tokenizer.from_file(queries.byte_model())
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]


@pytest.mark.parametrize("block", [64, T.BLOCK])
def test_token_files(spark, many, block):
    rows, frame = many
    path = scratch_path(spark, "test-tokens")
    T.write(frame.repartition(5), queries.byte_model(), path, block=block, step=16 if block == 64 else T.STEP)
    wanted = plain_tokens(rows)
    got = T.read(spark, path).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((i, tuple(ids)) for i, ids in wanted)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids)
    said = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in T.digests(spark, path).collect()}
    assert said == {(r.doc_id, r.start): (len(r.ids), zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in got}
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert max(b.n for b in blocks) <= block and (block > 64 or max(len(b.rows) for b in blocks) > 1)


def test_token_files_of_nothing(spark, none):
    path = scratch_path(spark, "test-tokens")
    T.write(none, queries.byte_model(), path)
    assert T.digests(spark, path).collect() == [] and T.read(spark, path).collect() == []


def test_token_files_of_empty_texts(spark):
    path = scratch_path(spark, "test-tokens")
    T.write(spark.createDataFrame([(2, ""), (1, None)], "doc_id long, text string"), queries.byte_model(), path)
    assert [tuple(r) for r in T.read(spark, path).orderBy("start").collect()] == [(1, 0, [0]), (2, 1, [0])]
    path = scratch_path(spark, "test-tokens")
    T.write(spark.createDataFrame([(2, ""), (1, "a b")], "doc_id long, text string"), queries.byte_model(), path, end_id=None)
    assert sorted((r.doc_id, len(r.ids)) for r in T.read(spark, path).collect()) == [(1, 2), (2, 0)]


def test_crc_of_joined_parts():
    data = bytes(range(256)) * 9
    assert T.joined_crc([(len(p), zlib.crc32(p)) for p in (data[:5], b"", data[5:1000], data[1000:])]) == zlib.crc32(data)


def test_long_texts_are_cut_without_a_trace():
    library = byte_tokens.ByteTokens(queries.byte_model())
    text = "Ab cd  ef\n gh it's 12 x <|endoftext|> z " * 300
    pieces = list(byte_tokens.cut(text, 50))
    assert len(pieces) > 100 and "".join(pieces) == text
    assert np.concatenate(library.encode(pieces)).tolist() == library.encode([text])[0].tolist()


SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "\u200b\u180e\ufeff"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(SPACES), st.sampled_from("ab'sé1<|>.日"), st.characters()), max_size=25), max_size=4))
def test_words_are_encoded_like_whole_texts(library, texts):
    texts = [*texts, "".join(f"a{s}b{s}{s}c{s} d{s}\n" for s in SPACES), "x<|endoftext|>  y", "", " "]
    plain = [e.ids for e in library.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in library.encode(texts)] == plain


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'é日😀 \t\n\r\x0b\x0c\u200b"), max_size=12), max_size=5))
def test_words_cut_from_bytes(texts):
    for cut in (byte_tokens.plain_words, byte_tokens.wide_words):
        words, number = cut(texts)
        assert words.to_pylist() == [w for t in texts for w in byte_tokens.WORD.findall(t)]
        assert number.tolist() == [len(byte_tokens.WORD.findall(t)) for t in texts]


def test_ids_wait_as_bytes(spark):
    """Lists of numbers cost Spark and Arrow a step for each token, three times over."""
    made = T.tokens(spark.createDataFrame([(1, "some words, some more"), (2, None)], "doc_id long, text string"), queries.byte_model())
    assert dict(made.dtypes)["ids"] == "binary"
    library = byte_tokens.ByteTokens(queries.byte_model()).tokenizer
    assert {r.doc_id: np.frombuffer(r.ids, "<i4").tolist() for r in made.collect()} == {1: [*library.encode("some words, some more").ids, 0], 2: [0]}
    assert {r["id"]: r["n"] for r in T.id_counts(made).collect()}[0] == 2


def test_the_table_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(byte_tokens, "TABLE_WORDS", 5)
    library = byte_tokens.ByteTokens(queries.byte_model())
    for n in range(20):
        text = f"a{n} b{n} " + "long" * 100
        assert library.encode([text])[0].tolist() == library.tokenizer.encode(text).ids
        assert len(library.words) + len(library.words.older) <= 2 * (5 + 2) and " " + "long" * 100 not in library.words


@pytest.fixture(scope="module")
def library():
    return byte_tokens.ByteTokens(queries.byte_model())


# --------------------------------------------------------------------- alignment
def plain_alignment(rows):
    """Per row (n_a, n_b, groups, links) with links as id pairs."""
    library, sp = Tokenizer.from_file(queries.byte_model()), sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    library.encode_special_tokens = True
    out = []
    for _, t in rows:
        a, b = (library.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        words = [bytes_of_a(library, i) for i in a], [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or b"".join(words[0]) != (" " + t).encode() or b"".join(words[1]) != (" " + t).encode():
            out.append((0, 0, [], []))
            continue
        i = j = ends = endt = 0
        groups, links, now = [], [], ([a[0]], [b[0]])
        ends, endt = len(words[0][0]), len(words[1][0])
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = ends <= endt, endt <= ends
            if step_a and step_b:
                groups.append(now)
                now = ([], [])
            if step_a:
                i += 1
                if i < len(a):
                    ends += len(words[0][i])
                    now[0].append(a[i])
            if step_b:
                j += 1
                if j < len(b):
                    endt += len(words[1][j])
                    now[1].append(b[j])
            if i == len(a) and j == len(b):
                break
        out.append((len(a), len(b), groups, links))
    return out


LETTERS = byte_tokens._byte_letters()


def bytes_of_a(library, i):
    return bytes(LETTERS[c] for c in library.id_to_token(i))


def plain_result(rows):
    made = plain_alignment(rows)
    counts = Counter(link for *_, links in made for link in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha(
        ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)) if groups else "") for (i, _), (n_a, n_b, groups, links) in zip(rows, made)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(SPACES), st.sampled_from("ab'sé1<|>.日▁"), st.characters()), max_size=25), max_size=4))
def test_both_sides_are_encoded_like_whole_texts(both, texts):
    texts = [*texts, "".join(f"a{s}b{s}{s}c{s} d{s}\n" for s in SPACES), "x\n  y \n z  ", "", " ", "\n", "a▁b", "<s> <0x41>"]
    for text, pieces in zip(texts, both.tokens(texts)):
        whole = both._whole([" " + text])[0] if text else None
        got = [tuple(ids.tolist() for ids in side) for side in zip(*pieces)]
        assert ([sum(side, ()) for side in (tuple(map(tuple, x)) for x in got)] if pieces else None) == (
            None if whole is None else [tuple(ids.tolist()) for ids in whole])


@pytest.fixture(scope="module")
def both():
    return A.Pair(queries.byte_model(), queries.piece_model())


@pytest.mark.parametrize("size", [100, A.LINKS])
def test_alignment(many, size):
    rows, frame = many
    got = A.align(frame.repartition(3), queries.byte_model(), queries.piece_model(), size=size)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_result(rows))
    assert dict(got.dtypes)["n_best"] == "bigint"


def test_alignment_of_given_documents(spark, folder):
    docs = queries.table(spark, folder, "documents")
    got = queries.op11_alignment(spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter(plain_result([(r.doc_id, r.text) for r in docs.collect()]))


def test_alignment_of_nothing(none):
    assert A.align(none, queries.byte_model(), queries.piece_model()).collect() == []


def test_groups_as_text(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in A.groups_of(docs, queries.byte_model(), queries.piece_model()).collect()}
    (_, _, groups, _), _ = plain_alignment([(1, "hello world"), (2, None)])
    assert got == {1: ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups), 2: ""}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_groups_are_cut_at_all_common_ends(left, right):
    a, b = np.cumsum(left), np.cumsum(right)
    end = max(a[-1], b[-1])  # both end together
    a, b = (x if x[-1] == end else np.append(x, end) for x in (a, b))
    leaves = A.groups(a, b, np.array([[0, len(a), 0, len(b)]]))
    common = np.intersect1d(a, b)
    assert a[leaves[:, 1] - 1].tolist() == common.tolist() == b[leaves[:, 3] - 1].tolist()
    assert leaves[0, [0, 2]].tolist() == [0, 0] and (leaves[1:, 0] == leaves[:-1, 1]).all() and (leaves[1:, 2] == leaves[:-1, 3]).all()
    begin_a, begin_b = np.append(0, a[:-1]), np.append(0, b[:-1])
    wanted = {(i, j) for i in range(len(a)) for j in range(len(b)) if begin_a[i] < b[j] and begin_b[j] < a[i]}
    i, j, leaf = A.links(a, b, leaves)
    assert len(i) == len(wanted) and set(zip(i.tolist(), j.tolist())) == wanted
    assert ((leaves[leaf, 0] <= i) & (i < leaves[leaf, 1])).all()


def test_a_long_run_without_common_ends_takes_few_rounds():
    a, b = np.arange(2, 400_001, 2), np.append(np.arange(3, 399_999, 2), 400_000)
    assert len(A.groups(a, b, np.array([[0, len(a), 0, len(b)]]))) == 1


def test_words_with_other_signs_behind_are_learnt_once(library, both):
    """A word that stands before a comma, a stop and a number was three words to both tables."""
    text = " ".join(f"{word}{end}" for word in ("zonder", "quarbel", "été", "Ünther") for end in (",", ".", "!", ";", "12", ""))
    for table, encode in ((library.words, library.encode), (both.words, both.tokens)):
        table.clear()
        table.older.clear() if table.older else None
        encode([text])
        assert len(table) <= 11
    assert library.encode([text])[0].tolist() == library.tokenizer.encode(text).ids
    assert [ids.tolist() for ids in both.tokens([text])[0][0]] == [ids.tolist() for ids in both._whole([" " + text])[0]]
