import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewell.llm.idfiles import decode_values, encode_values, read_id_files, write_id_files

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_streams_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = encode_values(values)
        assert len(control) == -(-n // 4)
        assert (decode_values(control, data, n) == values).all()


def test_files_round_trip(spark, tmp_path):
    rows = [(3, "Hello world"), (1, None), (2, ""), (2, "again"), (9, "a<|endoftext|>b É 你好"), (None, "no id"), (4, "long text " * 4000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, part int").repartition(3)
    write_id_files(docs, str(tmp_path / "f"), BYTES, end_id=2)
    library = Tokenizer.from_file(BYTES)
    got = sorted(read_id_files(spark, str(tmp_path / "f"), with_ids=True).collect(), key=lambda r: r.start)
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    start, seen = 0, []
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        want[r.doc_id].remove(ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(bytes(r.ids)))
        start += len(ids)
        seen.append(r.doc_id if r.doc_id is not None else -1)
    assert seen == sorted(seen) and not any(want.values())


def test_empty_table(spark, tmp_path):
    write_id_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "f"), BYTES)
    assert read_id_files(spark, str(tmp_path / "f")).count() == 0
