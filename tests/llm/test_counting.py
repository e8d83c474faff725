import public_tokenizers
from tokenizers import Tokenizer

from tidewell.llm.counting import count_tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(1, None), (2, ""), (3, "Hello  World, don't!\n\n x"), (4, "word " * 500), (4, "word " * 500), (5, "a<|endoftext|>b<|endoftext|><|endof É"), (6, "你好 🙂 \x00\x0012 ꟱x ՘"), (None, "the the"), (7, " \t\n"), (8, "thing" * 3000)]


def test_counts_equal_the_library(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, pretoken string")
    library = Tokenizer.from_file(BYTES)
    want = sorted(((i or 0), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    for head in (200_000, 3, 0):
        got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens) for r in count_tokens(docs, BYTES, head_entries=head).collect())
        assert got == want


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


SCRIPTS = {
    "korean": "나라의 말이 중국과 달라 문자와 서로 통하지 아니하므로 ",
    "japanese": "いろはにほへと、ちりぬるを。わかよたれそ、つねならむ。 ",
    "hindi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता ",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق ",
    "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระ และเสมอภาคกัน ",
    "georgian": "ყველა ადამიანი იბადება თავისუფალი და თანასწორი ",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ",
}


def test_scripts_are_cut_by_the_library(spark):
    """No counted key is longer than the library's own longest pre-token, and the counts are the library's."""
    from tidewell.llm.counting import distinct_pretokens

    library = Tokenizer.from_file(BYTES)
    rows = [(k, text * 50) for k, text in enumerate(SCRIPTS.values())] + [(99, "".join(SCRIPTS.values()) + " plain <|endoftext|> end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    longest = max(b - a for _, text in rows for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text))
    keys = [r.pretoken for r in distinct_pretokens(docs, BYTES).collect()]
    assert max(map(len, keys)) <= longest < 60
    got = {r.doc_id: r.n_tokens for r in count_tokens(docs, BYTES).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_what_is_held_is_bounded_in_bytes(spark, monkeypatch):
    from tidewell.llm import counting

    docs = spark.createDataFrame([(k, f"word{k} shared " * 3) for k in range(50)], "doc_id long, text string")
    want = sorted((r.doc_id, r.n_tokens) for r in count_tokens(docs, BYTES).collect())
    table = counting.piece_counts(counting.distinct_pretokens(docs, BYTES), BYTES)
    least, head = counting.frequent(table, 200_000, 40)
    assert sum(len(w.encode()) for w in head) <= 40 and " shared" in head
    monkeypatch.setattr(counting, "TASK_BYTES", 64)
    assert sorted((r.doc_id, r.n_tokens) for r in count_tokens(docs, BYTES, head_entries=1).collect()) == want
