"""Ranked search, spelling variants and token files against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tidecast.llm import ranked, spelling, tokenfile

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, item bigint, term bigint, word string, n bigint, path string"
SMALL = str.maketrans({i: i + 32 for i in range(65, 91)})


def prose(n, seed, syllables="an the ing ed ción ü or st"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(syllables.split(), k=rng.randint(1, 4))) for _ in range(n))


def rows():
    texts = {i: prose(60 + 5 * i, i) for i in range(1, 40)}
    texts |= {
        40: None, 41: "", 42: " \n\t ", 43: "one", 44: "É日本 テスト I'LL x<|endoftext|>y <|endoftext|> ÀÖ×÷ÿİ \x00 \x85",
        45: texts[3], 46: prose(20000, 46), 47: "a" * 5000, 48: "  two  blanks    x \n\n y ", 49: "ing " * 300, None: "ing the an",
        -5: "negative Id", 50: "İİ é ​　z  ", 51: "x" + " " * 300 + "y",
    }
    made = [(k, v, "en", "s", len(v or ""), 0, 0, "w", 0, "p") for k, v in texts.items()]
    return made + [made[4], made[4]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(SMALL))


def plain_search(found, items, k):
    held = [(d, Counter(terms(t))) for d, t in found if terms(t)]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in items:
        scores = []
        for doc, counts in held:
            m = 75 + (25 * sum(counts.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m))
                for t in terms(text) if counts[t]
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out |= {(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores)[:k])}
    return out


def items():
    wide = " ".join(sorted({w for i in range(1, 12) for w in prose(60, i).split()}))  # more than 64 terms
    assert len(set(terms(wide))) > 64
    return [(1, prose(12, 3)), (2, prose(30, 4)), (3, "ing ing THE"), (4, "absent zebra"), (5, ""), (6, None), (7, wide), (8, "É日本"), (9, "y")]


@pytest.mark.parametrize("block,item_block,sampled,sent", [(4096, 256, 64, 8 << 20), (7, 2, 1, 8 << 20), (7, 2, 1, 0)])
def test_ranked_search_equals_brute_force(spark, docs, block, item_block, sampled, sent):
    given = [*items(), items()[0]]
    wanted = spark.createDataFrame(given, "item_id bigint, text string")
    found = ranked.search(docs, wanted, k=5, block=block, item_block=item_block, sampled=sampled, broadcast_bytes=sent).collect()
    assert {tuple(r) for r in found} == plain_search([r[:2] for r in rows()], items(), 5)
    # rows of the document that stands three times tie with themselves
    assert len(found) == sum(min(5, len(plain_search([r[:2] for r in rows()], [x], 99))) for x in items())


def test_ranked_search_of_empty_tables(spark, docs, none):
    wanted = spark.createDataFrame(items(), "item_id bigint, text string")
    assert ranked.search(none, wanted).count() == 0
    assert ranked.search(docs, wanted.limit(0)).count() == 0


def test_masks_skip_documents_below_the_last_place():
    rng = np.random.default_rng(1)
    n = 3000
    terms_of = [rng.choice(50, rng.integers(1, 12), replace=False) for _ in range(n)]
    row = {
        "docs": np.arange(n), "lengths": np.full(n, 40), "sizes": np.array([len(x) for x in terms_of]),
        "terms": np.concatenate(terms_of), "counts": rng.integers(1, 4, sum(map(len, terms_of))),
    }
    block = ranked.Block(row, np.arange(50), rng.integers(100, 5000, 50), n, 40 * n)
    scored = []
    plain, block.scores = block.scores, lambda docs, *rest: scored.append(len(docs)) or plain(docs, *rest)
    own, repeats = np.arange(0, 50, 3), np.ones(17, np.int64)
    best, ids = block.top(own, repeats, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0, 20)
    every = plain(np.arange(n), own, repeats)
    order = np.lexsort((np.arange(n), -every))[:20]
    assert (ids == order).all() and (best == every[order]).all()
    assert sum(scored) < n / 2


# spelling variants


def plain_words(found, least=5, every=97):
    counts = Counter()
    for doc, text in found:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    made = {}
    for word, n in counts.items():
        near = [w for w in counts if one_apart(word, w)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best and counts[best] >= 2 * n else None
        made[word] = (form, n, len(near), counts[form] if form else None)
    for word in made:
        root = word
        while made[root][0]:
            root = made[root][0]
        made[word] = (made[word][0], root, *made[word][1:])
    return made


def test_variants_equal_brute_force(docs, none):
    expected = plain_variants(plain_words([r[:2] for r in rows()], every=7))
    assert sum(x[0] is not None for x in expected.values()) > 20 and len(expected) > 100
    found = spelling.variants(docs, every=7).collect()
    assert len(found) == len(expected) and {r.word: tuple(r)[1:] for r in found} == expected
    assert spelling.variants(none).count() == 0


@pytest.mark.parametrize("slice_rows,chunk,block", [(50_000, 32_768, 8192), (40, 100, 16), (1, 3, 2)])
def test_near_words_in_crowded_lists(spark, slice_rows, chunk, block):
    """Most words share a start, so lists are cut into slices and pieces."""
    rng = random.Random(3)
    words = {"stand" + "".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(400)}
    words |= {"".join(rng.choices("aé", k=rng.randint(5, 9))) for _ in range(200)} | {"abcde" * 40, "abcde" * 40 + "x"}
    counts = {w: rng.randint(3, 9) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    found = spelling.near(table, slice_rows=slice_rows, chunk=chunk, block=block).collect()
    near = defaultdict(set)
    for a in words:
        near[a] = {b for b in words if one_apart(a, b)}
    assert {r.word: r.n_near for r in found} == {w: len(near[w]) for w in words}
    for r in found:
        best = min(near[r.word], key=lambda w: (-counts[w], w), default=None)
        assert (r.best.word, r.best.n) == (best, counts.get(best))


# token files


@pytest.mark.parametrize("bits", [1, 3, 13, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    raw = tokenfile.packed(ids, bits)
    assert len(raw) == -(-1000 * bits // 8)
    for low, high in [(0, 1000), (0, 1), (999, 1000), (17, 18), (5, 777), (8, 8)]:
        assert (tokenfile.unpacked(raw, bits, low, high) == ids[low:high]).all()
    assert tokenfile.width(1 << bits) == bits


def test_random_access_into_a_file():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in [3, 1, 400, 7, 1, 250, 90, 2]]
    writer = tokenfile.Writer(13, most=100)
    parts = [x for i, d in enumerate(docs) if (x := writer.add(i * 10, d))]
    parts += [x for x in [writer.block(), writer.close()] if x]
    file = tokenfile.File(b"".join(x + b"\n" for x in parts))
    whole, at = np.concatenate(docs), 0
    assert file.n_docs == len(docs) and file.n_ids == len(whole) and len(file.bytes) > 2
    for i, own in enumerate(docs):
        doc, start, ids = file.document(i)
        assert (doc, start) == (i * 10, at) and (ids == own).all()
        at += len(own)
    for low, high in [(0, 1), (2, 500), (400, 401), (0, len(whole)), (700, 9999)]:
        assert (file.ids(low, high) == whole[low:high]).all()
    with pytest.raises(ValueError):
        tokenfile.File(b"\n" * 100)


def test_token_files_hold_what_the_library_gives(spark, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    given = sorted(rows(), key=lambda r: -(1 << 63) if r[0] is None else r[0])
    folder = tokenfile.write(docs, VOCABULARY, block=500)
    found = sorted(tokenfile.read(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [r[0] for r in given]
    start = 0
    for row, want in zip(found, given):
        ids = np.array(tokenizer.encode(want[1] or "", add_special_tokens=False).ids + [2], "<u4")
        assert row.start == start and row.n_tokens == len(ids) and bytes(row.ids) == ids.tobytes()
        assert row.ids_crc32 == zlib.crc32(ids.tobytes())
        start += len(ids)
    total = tokenfile.directory(spark, folder).groupBy().sum("n_docs", "n_ids").first()
    assert tuple(total) == (len(given), start)
    assert tokenfile.read(spark, tokenfile.write(none, VOCABULARY)).count() == 0


def test_chunks_of_random_texts_have_the_ids_of_the_whole():
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(VOCABULARY), random.Random(7)
    with open(VOCABULARY, "rb") as file:
        own = tokenfile.Tokens(file.read(), most=500)
    pieces = ["a", "Ab", "é", " ", "  ", "\n", "\t", " ", " ", "\x85", "\x1c", "'s", "'", "12", "日", "😀", "́", "<|endoftext|>", "<|", "!?", "​", "İ", "foo-bar(12)", "x://y.z/q?a=1&b", "3.14%", "ab12cd", "\x7f", "a\x01b", "(", "n't"]
    for _ in range(300):
        texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(20)]
        for text, ids in zip(texts, own.encode(pa.array(texts))):
            assert np.frombuffer(ids, np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_stay_small(spark, docs):
    """A task's documents go to several files, whose order and contents are those of one."""
    with_many = tokenfile.write(docs, VOCABULARY, block=50, blocks=2)
    sizes = tokenfile.directory(spark, with_many).select("path").collect()
    assert any("-c001" in row.path for row in sizes)
    whole = tokenfile.write(docs, VOCABULARY, blocks=1 << 20)
    key = lambda r: (r.start, r.n_tokens)
    for with_ids in (False, True):
        found = sorted(tokenfile.read(spark, with_many, with_ids).collect(), key=key)
        assert found == sorted(tokenfile.read(spark, whole, with_ids).collect(), key=key)


def test_words_met_again_stay_in_memory():
    """Rare words in between don't push out those of every batch."""
    from tidecast.llm.common import BatchMemory

    made = []
    memory = BatchMemory(lambda new, known: (made.extend(new), known.update((w, w * 2) for w in new)), 100)
    usual = [f"u{i}" for i in range(40)]
    for step in range(20):
        words = [f"r{step}-{i}" for i in range(50)] + (usual if step % 4 < 2 else [])
        assert memory.of(words) == [w * 2 for w in words]
        assert len(memory.often) + len(memory.fresh) <= 200
    assert sum(w in usual for w in made) == len(usual)


def test_marks_share_the_ids_of_their_word():
    """A word with marks behind it is encoded once with and without them."""
    with open(VOCABULARY, "rb") as file:
        own = tokenfile.Tokens(file.read())
    texts = ["x oddword, oddword. oddword", "été! x été; ×, ÷. 3.14, a).", ", .", ""]
    for text, ids in zip(texts, own.encode(pa.array(texts))):
        assert np.frombuffer(ids, np.uint32).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    kept = {*own.chunks.memory.fresh, *own.chunks.memory.often}
    assert "oddword" in kept and not {"oddword,", "oddword."} & kept


def test_token_memory_outlives_a_task():
    """Tasks of one worker share what it remembers, and what the driver remembers does not travel with them."""
    from pyspark import cloudpickle
    from tidecast.llm.common import Held

    held = Held.read(VOCABULARY)
    tokenfile.tokens_of(held)
    sent = cloudpickle.dumps(tokenfile.tokens_of)
    first, second = (cloudpickle.loads(sent)(held) for _ in range(2))
    assert first is second
    assert len(sent) < len(held.raw) // 4


def test_another_operator_frees_the_token_memory():
    """A worker holds the memory of one operator at a time."""
    from tidecast.llm.common import Held, kept

    held = Held.read(VOCABULARY)
    first = tokenfile.tokens_of(held)
    kept("another", held.digest, dict)
    assert tokenfile.tokens_of(held) is not first
