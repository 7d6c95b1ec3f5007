from pyspark.sql import functions as F

from moodmill.functions import tokens as tok


def column(spark, values, expression, ddl="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {ddl}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_splits(spark):
    assert column(spark, ["a  b", "", "a"], tok.plain_text_split) == [["a", "", "b"], [""], ["a"]]
    assert column(spark, ["a😀b", ""], tok.char_split) == [["a", "😀", "b"], []]


def test_ngrams(spark):
    assert column(spark, ["abcd", "ab", "a😀b😀\n"], lambda c: tok.find_ngrams(c, 3)) == [
        ["abc", "bcd"], [], ["a😀b", "😀b😀", "b😀\n"],
    ]
    assert column(spark, ["ab"], lambda c: tok.find_ngrams(c, 0)) == [[]]


def test_word_ngrams(spark):
    assert column(spark, ["cat"], tok.word_ngrams) == [
        ["<ca", "cat", "at>", "<cat", "cat>", "<cat>"]
    ]
    assert column(spark, ["on", ""], tok.word_ngrams) == [["<on", "on>", "<on>", "on"], [""]]
    assert column(spark, [" "], lambda c: tok.word_ngrams(c, 1)) == [["<", " ", ">", "< ", " >", "< >", " "]]


def test_padding(spark):
    values = [[1, 2, 3], [], [1, 2, 3, 4, 5]]
    assert column(spark, values, lambda c: tok.pad_sequence(c, 4), "array<int>") == [
        [1, 2, 3, 0], [0, 0, 0, 0], [1, 2, 3, 4],
    ]
    assert column(spark, values, lambda c: tok.sequence_length(c, 4), "array<int>") == [3, 0, 4]
    assert column(spark, [["a"]], lambda c: tok.pad_words(c, 3), "array<string>") == [["a", " ", " "]]
