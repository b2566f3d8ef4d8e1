import re

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import tokenize


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first()[0]


def test_words_and_windows(spark):
    assert one(spark, "Don't STOP-é 42", T.words) == ["don", "t", "stop", "42"]
    assert one(spark, "a b", lambda v: T.ngrams(T.words(v), 3)) == []
    assert one(spark, "a b c d", lambda v: T.ngrams(T.words(v), 3)) == ["a b c", "b c d"]
    assert one(spark, None, T.words) is None


def test_title_keys(spark):
    for title, key in [
        ("  Spider @-@ Man  2 ", "spider-man 2"), ("10 @,@ 000 ( film )", "10,000 (film)"), ("A – B", "a–b"), ("Straße", "strasse"), ("What ?", "what?"), ("", ""),
    ]:
        assert one(spark, title, T.title_key) == key


def test_case_folding_as_python(spark):
    for text in ("ΟΔΟΣ ΣΟΣ", "ﬁn ŉ Ǆ ẞ ß ſ", "İstanbul ıI", "ᏸ Ꭰ ᾳ ᾼ", "plain ÄÖ"):
        assert one(spark, text, T.casefold) == text.casefold()


def test_headings(spark):
    cases = [(" = Title = \n", "Title", True), (" = = Section = = \n", None, False), (" = Title = ", "Title", False), ("= Title =\n", None, False), ("", None, False), (" = A = B = \n", "A = B", True)]
    for line, title, page in cases:
        assert one(spark, line, T.heading_title) == title
        assert one(spark, line, T.starts_page) is page


def test_space_words_as_python(spark):
    for s in ("", " a b ", "a", " x y", "a\x1cb"):
        assert one(spark, s, T.space_words) == len(re.split(r"\s+", s))


def test_item_texts(spark):
    row = lambda d, s: spark.createDataFrame([(d,)], f"r struct<{s}>")
    get = lambda df, b: df.select(T.item_texts(b, F.col("r"))).first()[0]
    assert get(row(("c", ["x", "y"]), "ctx string, endings array<string>"), "endings") == ["c x", "c y"]
    assert get(row(("q", (["x"],)), "question string, choices struct<text: array<string>>"), "choices") == ["q x"]
    assert get(row(("g", "a", "b"), "goal string, sol1 string, sol2 string"), "solutions") == ["g a", "g b"]
    assert get(row(("_ met _", "A", "B"), "sentence string, option1 string, option2 string"), "blank") == ["A met A", "B met B"]


def test_pieces_as_library(spark):
    from tokenizers import Regex, pre_tokenizers

    texts = ["It's 12345 o'clock!\n\n  done", "été 漢字 😀  x\t\r\n y", "", "   ", "a\x1cb  \x85c"]
    split = pre_tokenizers.Split(Regex(tokenize.SPLIT.removeprefix("(?U)")), "isolated")
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tokenize.pieces("t")).collect()]
    assert got == [[p for p, _ in split.pre_tokenize_str(t)] for t in texts]


def test_encode_decode(spark):
    from millrace.plans.tokens import vocabulary

    source = vocabulary()
    df = spark.createDataFrame([(0, "Hello, wörld  😀"), (1, None), (2, "")], "i int, t string")
    rows = df.select("i", tokenize.encoder(spark, source, 7)("t").alias("ids")).select("i", "ids", tokenize.decoder(spark, source)(F.slice("ids", 2, 100)).alias("back")).orderBy("i").collect()
    assert [r.back for r in rows] == ["Hello, wörld  😀", "", ""]
    assert [r.ids[0] for r in rows] == [7, 7, 7] and len(rows[2].ids) == 1


def test_whole_table_as_library(spark, sf):
    """Piece counts, ids and decoded texts of every document against the tokenizers library itself."""
    import collections
    import hashlib

    import numpy as np
    from tokenizers import Regex, Tokenizer, pre_tokenizers

    from millrace.plans import tokens

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    split = pre_tokenizers.Split(Regex(tokenize.SPLIT.removeprefix("(?U)")), "isolated")
    want = collections.Counter(p for r in docs for p, _ in split.pre_tokenize_str(r.text))
    assert {r.piece: r.n for r in tokens.piece_counts(spark, sf).collect()} == want
    tok = Tokenizer.from_str(tokens.vocabulary())
    ids = {r.doc_id: [tokens.BOS, *tok.encode(r.text, add_special_tokens=False).ids] for r in docs}
    digest = lambda x: hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha) for r in tokens.encoded_docs(spark, sf).collect()} == {i: (len(x), digest(x)) for i, x in ids.items()}
