"""Every language has a model of its own."""

from driftline.llm import op9_quality_rules as q


def test_languages_share_no_number(spark):
    names = [f"l{i}" for i in range(100)] + [None, ""]
    df = spark.createDataFrame([(n,) for n in names], "lang string")
    numbers = q.languages(df)
    assert set(numbers) == set(names) and len(set(numbers.values())) == len(names)


def test_a_language_is_scored_by_its_own_model(spark):
    rows = [("abab " * 30, "de")] * 3 + [("cdcd " * 30, "es")] * 3
    df = spark.createDataFrame(rows, "text string, lang string")
    model = q.fit(df)
    codes = q.SymbolTable().codes("abab " * 30)
    loss = {x: -model.score(codes.astype("int64") | n << 20).mean() for x, n in model.numbers.items()}
    assert loss["de"] + 2 < loss["es"]
