import pytest

from termloom import app

PATTERNS = """name: "A + N" body: {
  w:d ADJ | rec
  w:h NOUN
}
name: "N + of + N" body: {
  w:h NOUN
  w:i ADP | exlex:"of"
  w:d NOUN
}
"""


def test_commands_from_texts_to_terms(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    for i, text in enumerate(("The portable engine and the model of language work in many noble houses.", "A portable engine works. The noble model of language is a portable engine.", "Nothing here but the ordinary talk of people in their houses.")):
        (tmp_path / "texts" / f"art{i}_text.txt").write_text(text)
        (tmp_path / "texts" / f"art{i}_title.txt").write_text(f"title {i}")
    (tmp_path / "patterns").write_text(PATTERNS)
    (tmp_path / "stop").write_text("the\na\n")
    spark.createDataFrame([("portable", "s1"), ("mobile", "s1"), ("engine", "s2")], "lemma string, synset string").write.parquet(str(tmp_path / "senses"))
    spark.createDataFrame([("s2", "s1")], "synset string, hypernym string").write.parquet(str(tmp_path / "links"))
    p = app.Pipeline(spark, app.Options(str(tmp_path), str(tmp_path / "patterns"), str(tmp_path / "stop"), senses_file=str(tmp_path / "senses"), links_file=str(tmp_path / "links")))
    for command in app.COMMANDS:
        getattr(p, command)()
    got = {r["key"]: r for r in p.stored("clusters").collect()}
    assert got["portable engine"]["cnt"] == 3 and got["portable engine"]["frequency"] == 1.0 and got["model of language"]["docs"] == 2
    terms = {r["key"]: r["context"] for r in p.stored("terms").collect()}
    assert terms["portable engine"].count("|") == 2
    assert ("portable", "synonym", "mobile") in {tuple(r) for r in p.stored("lemma_relations").collect()}
    assert p.stored("topic_words").count() > 0


def test_options():
    args = app.parser().parse_args(["collect_phrases", "--corpus-dir", "x", "--clean-stop-words", "false"])
    assert args.clean_stop_words is False and args.validate_boundaries is True
    with pytest.raises(ValueError):
        app.Options("x", limit=0)
    with pytest.raises(ValueError):
        app.Pipeline(None, app.Options("x")).needed("patterns_file")
