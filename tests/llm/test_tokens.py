"""BPE by chunks, token files and token counts against the library itself."""

import pickle
import time
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.bpe import ChunkEncoder, cuts, digests, encode
from tessera.llm import counts
from tessera.llm.counts import frequent_lengths, token_counts
from tessera.llm.pieces import PieceEncoder, public_path, tokenizer
from tessera.llm.tokenio import SequenceFile, SequenceWriter, put_in_place, read_token_files, write_token_files
from tessera.llm.trees import FAN_IN, SUMMARY, merged
from tessera.session import Scratch

WORD, BYTE = public_path("word_bpe_49k.json"), public_path("byte_bpe_50k.json")
TEXT = st.lists(st.sampled_from([*"abzÉß1.!'#\n\t \x1c\x85\xa0\u3000\u0301", " ", "  ", "'s", "the ", " of", "<|endoftext|>", "<|startoftext|>", "\u4e2d", "\U0001f389", "\u0130"]) | st.characters(exclude_categories=["Cs"]), max_size=120).map("".join)
ENCODERS = {p: PieceEncoder(p, limit=500) for p in (WORD, BYTE)}
CHUNKS = {p: ChunkEncoder(p, 3, 4) for p in (WORD, BYTE)}


def ids_of(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_pieces_and_chunks_give_the_library_s_ids(text):
    for path in (WORD, BYTE):
        wanted = ids_of(path, text)
        assert np.frombuffer(b"".join(ENCODERS[path].records(text)), dtype=ENCODERS[path].kind).tolist() == wanted
        coder = CHUNKS[path]
        got = coder.ids(text)
        assert got.tolist() == wanted
        assert coder.decode(got) == tokenizer(path).decode(wanted, skip_special_tokens=False)


def test_cuts_depend_on_the_content_only():
    data = np.random.default_rng(0).integers(97, 123, 50_000, dtype=np.uint8)
    one, two = cuts(data), cuts(np.concatenate([data[:1000][::-1], data]))
    shared = {c + 1000 for c in one} & set(two)
    assert len(one) > 10 and len(shared) >= len(one) - 2


def test_shared_chunks_are_encoded_once_they_are_known():
    coder = ChunkEncoder(WORD)
    text = " ".join(f"word{i}" for i in range(5000))
    for _ in range(3):
        coder.ids(text)
    assert coder.reused == 2 * coder.encoded > 0
    coder.ids("another beginning " + text[:20_000])
    assert coder.reused > 2 * coder.encoded


def test_passages_that_documents_share_are_reused():
    words = [f"word{i}" for i in range(400)]
    coder = ChunkEncoder(WORD)
    coder.ids("one " + " ".join(words))
    first = coder.encoded
    coder.ids("quite another start of a text " + " ".join(words) + " and end")
    assert coder.encoded - first <= 4 and coder.reused >= first - 3


def test_unbroken_texts_and_scripts_without_spaces():
    """Ids as the library has them, in time proportional to the length."""
    rng = np.random.default_rng(3)
    han = "".join(map(chr, rng.integers(0x4E00, 0x9FA0, 30_000)))
    thai = "".join(map(chr, rng.integers(0x0E01, 0x0E3A, 30_000)))
    base64 = "".join(rng.choice(list("ABCDEFghijklmnop0123456789+/"), 30_000))
    for path in (WORD, BYTE):
        for text in (han, thai, base64, "a" * 30_000, "e\u0301" * 9000, "\u3002".join([han[:4000], thai[:4000]]), base64 + " " + base64 + "\n", " " * 9000, "x" + "\n" * 9000 + "y"):
            assert ChunkEncoder(path).ids(text).tolist() == ids_of(path, text)


def test_a_very_long_word_takes_a_few_times_what_the_library_takes():
    text = "".join(np.random.default_rng(4).choice(list("abcdefghijklmnopqrstuvwxyz"), 800_000))
    for path in (WORD, BYTE):
        began = time.perf_counter()
        wanted = ids_of(path, text)
        library, began = time.perf_counter() - began, time.perf_counter()
        assert ChunkEncoder(path).ids(text).tolist() == wanted
        assert time.perf_counter() - began < 3 * library + 1


def test_encode_digests_and_round_trip(odd_docs, no_docs):
    texts = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in odd_docs.collect()))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(odd_docs).collect())
    wanted = []
    for null, i, text in texts:
        ids = ids_of(WORD, text)
        wanted.append((null, i, len(ids), sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), sha256(tokenizer(WORD).decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(wanted)
    assert digests(no_docs).count() == 0
    for r in encode(odd_docs.select("doc_id", "text"), BYTE).join(odd_docs.select("doc_id", "text"), "doc_id").collect():
        assert r.decoded == (r.text or "") and r.ids == ids_of(BYTE, r.text)


def test_counts(spark, odd_docs, no_docs):
    for path in (WORD, BYTE):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd_docs, path, limit=50, table_size=8).collect())
        wanted = sorted((str(r.doc_id), len((r.text or "").encode()), n := len(ids_of(path, r.text)), n > 50) for r in odd_docs.collect())
        assert got == wanted
    assert token_counts(no_docs, WORD).count() == 0
    assert 0 < len(frequent_lengths(odd_docs, WORD, 8)) <= 8


def test_counts_of_a_sentencepiece_model(odd_docs):
    import sentencepiece

    path = public_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    some = odd_docs.filter("length(text) < 2000")
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts(some, path).collect())
    assert got == sorted((str(r.doc_id), len(model.encode(r.text))) for r in some.collect())


def test_token_files(spark, odd_docs, no_docs):
    root = Scratch(spark, "files").root
    files = write_token_files(odd_docs, BYTE, root, end_id=2, length=16, rows=4)
    got = read_token_files(files, root).collect()
    at, wanted = 0, []
    hashed = odd_docs.withColumn("hash", F.xxhash64("text")).collect()
    for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.hash)):
        ids = [*ids_of(BYTE, r.text), 2]
        wanted.append((str(r.doc_id), at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(wanted)
    empty = Scratch(spark, "files").root
    assert read_token_files(write_token_files(no_docs, BYTE, empty, end_id=2), empty).count() == 0


def test_any_sequence_of_a_file_is_a_view_at_a_computed_place(tmp_path):
    flat = np.random.default_rng(2).integers(0, 50_000, 16 * 4 * 9 + 37).astype("<u2")
    path = str(tmp_path / "some.ids")
    with pa.OSFile(path, "wb") as sink:
        writer = SequenceWriter(sink, flat.dtype, 16, 4)
        for at in range(0, len(flat), 31):
            writer.append(flat[at : at + 31])
        writer.close()
    n = -(-len(flat) // 16)
    file = SequenceFile(path)
    for i in (n - 1, 0, 30, 5, 30, 31):
        before = file.reads
        ids, mask = file.sequence(i)
        assert file.reads - before <= 1  # no batch but the one that holds it
        assert not ids.flags.owndata and len(ids) == len(mask) == 16
        some = flat[16 * i : 16 * i + 16]
        assert ids[: len(some)].tolist() == some.tolist() and mask.to_pylist() == [k < len(some) for k in range(16)]
    data = np.memmap(path, dtype=np.uint8)
    held = file.sequence(7)[0]
    assert data.tobytes().find(held.tobytes()) >= 0
    for i in (n + 3, 10_000, -1):
        with pytest.raises(IndexError):
            file.sequence(i)
    for start, size in ((0, 5), (14, 40), (100, 0), (16 * 4 * 9 - 3, 30)):
        assert file.ids(start, size).tolist() == flat[start : start + size].tolist()
    with pa.OSFile(path, "wb") as sink:
        SequenceWriter(sink, flat.dtype, 16, 4).close()
    with pytest.raises(IndexError):
        SequenceFile(path).sequence(0)


def test_a_repeated_task_leaves_the_file_that_is_there(tmp_path):
    class Strict(pyarrow.fs.LocalFileSystem):
        """Renames fail where the target exists, and the other task is quicker between the look and the move."""

        quicker = False

        def move(self, own, place):
            if self.quicker:
                (tmp_path / "file").write_text("whole")
            if self.get_file_info(place).type != pyarrow.fs.FileType.NotFound:
                raise OSError("target exists")
            super().move(own, place)

    for quicker in (False, True):
        fs = Strict()
        fs.quicker = quicker
        for _ in range(2):
            (tmp_path / "own").write_text("whole")
            put_in_place(fs, str(tmp_path / "own"), str(tmp_path / "file"))
            assert sorted(p.name for p in tmp_path.iterdir()) == ["file"] and (tmp_path / "file").read_text() == "whole"
        (tmp_path / "file").unlink()
    with pytest.raises(OSError):
        put_in_place(pyarrow.fs.LocalFileSystem(), str(tmp_path / "none"), str(tmp_path / "file"))


def test_long_pieces_do_not_fill_the_summaries(monkeypatch):
    rng = np.random.default_rng(1)
    batches = (pa.record_batch({"text": [" ".join("".join(rng.choice(list("abcdef"), 2000)) for _ in range(50)) + " short words"]}) for _ in range(8))
    held, trim = [], counts._trim
    monkeypatch.setattr(counts, "_trim", lambda found, size: held.append(sum(map(len, found))) or trim(found, size))
    monkeypatch.setattr(counts, "summary", lambda blob: blob)
    (blob,) = counts._summaries(batches, WORD, 100)
    assert held == [len("shortwords")] and set(pickle.loads(blob)) == {"short", "words"}


def test_summaries_meet_in_order_and_few_at_a_time(spark):
    join = lambda a, b: a + b"," + b
    for n in (0, 1, FAN_IN, FAN_IN + 1, 3 * FAN_IN * FAN_IN + 5):
        rows = [(i, str(i).encode()) for i in range(n) if i % 7 != 3]  # some tasks give none
        got = merged(spark.createDataFrame(rows, SUMMARY).repartition(5), join, Scratch(spark, "tree"), "rows")
        assert got == (b",".join(b for _, b in rows) if rows else None)
