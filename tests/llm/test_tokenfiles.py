import uuid
import zlib

import numpy as np
import pytest

from tests.llm.helpers import edge_rows, prose, table
from thicket.llm import tokenfiles as T
from thicket.llm._store import shared_dir

ODD = ["a\x0bb c\x1cd\x1ee", "it's ~ what~ 'twas don't", "<|endoftext|>x y<|startoftext|>", "é́ ́a İstanbul ΣΑΣ 42abc", "KK   nb sp　x", "` ;", "word. word, it's. a'. é. ñ?! x.y .. 5. ﬁ. İ. ΑΣ. !?", "  . a"]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))


def folder(spark):
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"


def rows():
    return [*edge_rows(), *((20 + k, t) for k, t in enumerate(ODD)), *((None if k % 3 == 0 else 1000 - k, prose(k, 1 + 7 * k)) for k in range(60))]


def plain(rows, tokenizer):
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    return [(d, ids(t)) for d, t in rows]


@pytest.mark.parametrize("part_bytes", [32 << 20, 5_000])
def test_equals_whole_encoding(spark, tokenizer, part_bytes):
    given = [(d, t) for d, t, *_ in rows()]
    at = folder(spark)
    manifest = T.write(table(spark, rows()), at, T.TokenParams(part_bytes=part_bytes))
    got = sorted(T.documents(manifest, at).collect(), key=lambda r: r.start)
    # null ids first, then ascending; each start is the sum of all before
    assert [r.doc_id for r in got] == sorted((d for d, _ in given), key=lambda d: (d is not None, d or 0))
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    want = [(d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in plain(given, tokenizer)]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    # memory-mapped access by number and across parts
    parts = manifest.collect()
    files = T.TokenFiles(at, parts)
    assert len(files) == len(given) and (len(parts) > 1) == (part_bytes < 1 << 20)
    whole = files.window(0, 10**9)
    assert len(whole) == sum(len(i) for _, i in plain(given, tokenizer))
    for k, r in enumerate(got):
        assert len(files[k]) == r.n_tokens and (files[k] == whole[r.start : r.start + r.n_tokens]).all()
    assert whole.dtype == np.uint16 and isinstance(files.part(0).ids, np.memmap)
    with pytest.raises(IndexError):
        files[len(files)]


def test_whole_texts_and_wide_ids(spark, tokenizer):
    given = [(k, t) for k, t in enumerate(ODD)]
    at = folder(spark)
    manifest = T.write(table(spark, given), at, T.TokenParams(end_id=70_000, by_word=False))
    assert [r.dtype for r in manifest.collect()] == ["<u4"]
    files = T.TokenFiles(at, manifest.collect())
    for k, (_, ids) in enumerate(plain(given, tokenizer)):
        assert files[k].tolist() == [*ids[:-1], 70_000]


def test_memory_of_words_turns_over(tokenizer):
    import pyarrow as pa

    texts = [prose(k, 40, 5000) for k in range(50)]
    e = T.Encoder(T.TokenParams(cache=60))
    for t in texts:
        out, _ = e.encode(pa.array([t]))
        assert out.tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
    assert len(e.known) + len(e.older) < 200


def test_bases_in_blocks(spark):
    n = 50
    parts = spark.createDataFrame([(k, f"p{k}", k + 1, 10 * k + 3, "<u2") for k in range(n)], "part bigint, name string, n_docs bigint, n_ids bigint, dtype string")
    got = {r.part: (r.docs_before, r.ids_before) for r in T.with_bases(parts, 7).collect()}
    assert got == {k: (sum(j + 1 for j in range(k)), sum(10 * j + 3 for j in range(k))) for k in range(n)}


def test_parts_that_are_not_whole_are_refused(spark):
    at = folder(spark)
    manifest = T.write(table(spark, [(1, "some words")]), at)
    cut = manifest.withColumn("n_ids", manifest.n_ids + 1)
    with pytest.raises(Exception, match="manifest"):
        T.documents(cut, at).collect()


def test_empty_table_and_query(spark, small):
    at = folder(spark)
    manifest = T.write(table(spark, []), at)
    assert manifest.count() == 0 and T.documents(manifest, at).count() == 0 and len(T.TokenFiles(at, [])) == 0
    out = T.op11_token_files(spark, small)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 200
