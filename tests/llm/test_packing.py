import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewell.llm.packing import CapacityTree, pack_documents, plan_best_fit, sequences

WORDS = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    """Plain best-fit decreasing: the number of bins."""
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, x in enumerate(left) if x >= n]
        if fit:
            left[min(fit, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


def test_tree_finds_the_tightest():
    tree = CapacityTree(10)
    for c in (3, 7, 10):
        tree.add(c, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 8, 10)] == [3, 3, 7, 10, 10]
    tree.add(10, -1)
    assert tree.tightest(8) == -1


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for capacity in (7, 50, 64):
        for _ in range(20):
            lengths = rng.integers(1, capacity + 1, 80)
            plan = plan_best_fit(np.bincount(lengths, minlength=capacity + 1), capacity)
            used = {}
            for n in range(1, capacity + 1):
                for rank in range(int((lengths == n).sum())):
                    at = np.flatnonzero((plan["length"] == n) & (plan["first"] <= rank))[-1]
                    k = rank - plan["first"][at]
                    b, off = plan["bin"][at] + k // plan["each"][at], plan["base"][at] + k % plan["each"][at] * n
                    used.setdefault(int(b), []).append((int(off), n))
            for spans in used.values():
                end = 0
                for off, n in sorted(spans):
                    assert off == end
                    end += n
                assert end <= capacity
            assert sorted(capacity - sum(n for _, n in s) for s in used.values()) == best_fit(lengths.tolist(), capacity)


def test_packs_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  World, don't!", "x"), (4, "word " * 300, "x"), (4, "word " * 300, "x"), (5, "a<|endoftext|>b É", None), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = pack_documents(docs, WORDS, capacity=64, end_id=1, with_ids=True)
    library = Tokenizer.from_file(WORDS)
    want = []
    for doc, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            want.append((doc, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())))
    found = got.collect()
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], key=key) == sorted(want, key=key)
    spans = {}
    for r in found:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        end = 0
        for off, n in sorted(s):
            assert off == end
            end += n
        assert end <= 64
    assert len(spans) == len(best_fit([w[3] for w in want], 64))
    assert {r.sequence_id: len(r.ids) // 4 for r in sequences(got).collect()} == {k: sum(n for _, n in s) for k, s in spans.items()}


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0
