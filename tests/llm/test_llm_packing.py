import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from quire.llm.packing import Bins, Ids, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", None, "  x \n\n y\t", "it's we'll  don'T I'm you're'll'x ''s a'Lx b'llama c't", "ŁódŹ 中文 🎉 x²", "hi there", "a\x0bb\x1c c", "<|endoftext|> x",
    "é́ ÀÖ×÷ß 12a3 ª º µ ¼", "\r\n\r\n  end ", " ", "\n", "'", "'s", " 's", "a 12 !? b", "x" * 3000, "  ",
]


def test_ids_are_the_tokenizers():
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choice(["a", "'", "s", " ", "\n", "é", "É", "1", ".", "re", "ll", "the", "中", "\t"]) for _ in range(rnd.randint(0, 20))) for _ in range(800)]
    whole = Tokenizer.from_file(PATH)
    for t, ids in zip(texts, Ids(PATH).of(pa.array(texts, pa.string()))):
        assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids, t


def test_bins_hold_everything_and_search_empties_bins():
    rnd = random.Random(3)
    for lengths in ([rnd.randint(1, 99) for _ in range(300)], [60] * 7 + [40] * 7, [50, 50, 34, 33, 33, 26, 25, 25, 24], [], [100], [34, 34, 33, 33, 33, 33]):
        bins = Bins(lengths, 100).bins
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
        least = max(-(-sum(lengths) // 100), sum(n > 50 for n in lengths))
        assert len(bins) <= 1.08 * least + 1


def test_swap_beats_best_fit_decreasing():
    lengths = [7, 6, 5, 4, 4, 4]  # best fit decreasing leaves 7 and 4+4 beside others; 15 each is possible
    assert len(Bins(lengths, 15).bins) == 2


def exchanges(x, y):
    """Net lengths that x can give to y: a move, one for one, two for one, one for two."""
    ones, twos = (lambda b: list(b)), (lambda b: [b[i] + b[j] for i in range(len(b)) for j in range(i)])
    return {g - t for gs, ts in ((ones(x), [0]), (ones(x), ones(y)), (twos(x), ones(y)), (ones(x), twos(y))) for g in gs for t in ts}


def test_search_ends_where_no_exchange_adds():
    rnd = random.Random(8)
    for low, high, n in ((500, 900, 150), (300, 1200, 120), (1, 2047, 150), (900, 1100, 60)):
        lengths = [rnd.randint(low, high) for _ in range(n)]
        bins = [[lengths[i] for i in b] for b in Bins(lengths, 2048).bins]
        if len(bins) == -(-sum(lengths) // 2048):
            continue  # no fewer could hold them
        for i, x in enumerate(bins):
            for y in bins[:i]:
                a, b = sum(x), sum(y)
                assert not any(a - t <= 2048 and b + t <= 2048 and (a - t) ** 2 + (b + t) ** 2 > a * a + b * b for t in exchanges(x, y))


def test_ids_of_whole_documents():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").combine_chunks()
    whole = Tokenizer.from_file(PATH)
    for t, ids in zip(texts.to_pylist(), Ids(PATH).of(texts)):
        assert ids.tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_ids_beyond_doubles_beside_a_null(spark):
    docs = spark.createDataFrame([(2**53 + 1, "a b"), (None, "c"), (2**53 + 3, "d")], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0, r.length) for r in pack(docs, PATH).collect()) == [(0, 2), (2**53 + 1, 3), (2**53 + 3, 2)]


def test_pieces_cover_documents(spark, odd_docs):
    got = pack(odd_docs, PATH, size=512).toPandas()
    whole = Tokenizer.from_file(PATH)
    want = []
    for r in odd_docs.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 0]
        a, b = 0, len(ids) % 512 or 512
        while a < len(ids):
            want.append((str(r.doc_id), a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
            a, b = b, b + 512
    listed = [(str(None if np.isnan(r.doc_id) else int(r.doc_id)), r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(listed) == sorted(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 512
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 512) + 1


def test_empty_table(no_docs):
    assert pack(no_docs, PATH).count() == 0
