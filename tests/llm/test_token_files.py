from __future__ import annotations

import glob
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import token_files as tf
from tallyframe.llm.common import fresh_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a  b", "a \n b", "a\n  b\n", "tab\t x", "don't  stop 's", "x <|endoftext|> y", "<|endoftext|>",
    "é ñ 漢字 😀 a", "1 2  3   4", "end ", "end\n", "a b c", "a  b", "a \x1fb", "ab" * 5000 + " " + "x" * 3000,
]


def test_pieces_encode_as_the_whole_text_does():
    plain, ours = Tokenizer.from_file(PATH), tf.Encoder(PATH)
    texts = [t or "" for t in ODD]
    for text, got in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_small_cache_changes_nothing():
    texts = [f"word{i} word{i % 7} other" for i in range(50)]
    assert tf.Encoder(PATH, kept=5).encode(texts) == tf.Encoder(PATH).encode(texts)


def test_round_trip_against_brute_force(spark):
    rows = [(i, t, "extra") for i, t in enumerate(ODD)] + [(3, "again", "x"), (None, "no id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    folder = fresh_path(spark, "t")
    manifest = tf.write_token_files(df, folder, PATH, frame_bytes=64)
    got = [tuple(r) for r in tf.read_token_files(manifest, folder).orderBy("start").collect()]
    plain, at, want = Tokenizer.from_file(PATH), 0, []
    for doc_id, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_single_documents_unpack_only_their_frames(spark, tmp_path):
    path = tmp_path / "x.tkz"
    with path.open("wb") as f:
        w = tf.FrameWriter(f, frame_bytes=400)
        for i in range(100):
            w.add(i, np.arange(i, i + 50, dtype="<u4").tobytes())
        w.close()
    with path.open("rb") as f:
        r = tf.FrameReader(f, path.stat().st_size)
        assert len(r.table) == 51
        got = dict(r.documents([7, 8, 93]))
        assert r.frames_read == 3
    assert np.frombuffer(got[93], "<u4").tolist() == list(range(93, 143))
    assert tf.read_documents(f"file://{path}", [7])[7].tolist() == list(range(7, 57))


def test_damage_is_noticed(tmp_path):
    path = tmp_path / "x.tkz"
    with path.open("wb") as f:
        w = tf.FrameWriter(f)
        w.add(1, bytes(range(200)))
        w.close()
    data = bytearray(path.read_bytes())
    data[12] ^= 1
    path.write_bytes(data)
    with path.open("rb") as f, pytest.raises(Exception):
        list(tf.FrameReader(f, len(data)).documents())


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = fresh_path(spark, "t")
    assert tf.read_token_files(tf.write_token_files(df, folder, PATH), folder).count() == 0
    assert not glob.glob(f"{folder.removeprefix('file://')}/*.tkz")
