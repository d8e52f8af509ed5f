"""Saved alignments and rule files."""

import pytest

from lexis.operators import inflection, snapshots
from lexis.sources import text_files


def test_versions_are_read_as_one(spark, tmp_path):
    path = f"file://{tmp_path}/alignment"
    make = lambda n: [spark.createDataFrame([(n, name)], "n int, name string") for name in snapshots.RELATIONS]
    assert snapshots.save(path, *make(1)) == 1 and snapshots.save(path, *make(2)) == 2
    assert [x.first() for x in snapshots.load(spark, path)] == [(2, name) for name in snapshots.RELATIONS]
    assert [x.first().n for x in snapshots.load(spark, path, 1)] == [1, 1, 1]
    make(3)[0].write.parquet(f"{path}/versions/halfway/mapping")  # a writer that died
    assert [x.first().n for x in snapshots.load(spark, path)] == [2, 2, 2]
    with pytest.raises(LookupError):
        snapshots.load(spark, path, 7)


def test_rule_file(spark, tmp_path):
    file = tmp_path / "rules.tsv"
    file.write_text("# comment\nて\tる\traw\tv1|vk\t-te\nせぬ\tする\tv5s\tvs-s|vs-i\tarchaic negative\nきた\tくる\traw\tvk\tpast\n")
    rules = inflection.rules_of(text_files.rules(spark, f"file://{file}"))
    bit = inflection.BIT
    assert rules == [("きた", "くる", bit["raw"], bit["vk"], "past", 0), ("せぬ", "する", bit["v5s"], bit["vs-s"] | bit["vs-i"], "archaic negative", 1), ("て", "る", bit["raw"], bit["v1"] | bit["vk"], "-te", 2)]
    own = {r[:5] for r in inflection.japanese_rules()}
    assert rules[1][:5] in own and rules[0][:5] in own
    found = inflection.closure(spark.createDataFrame([("食べて",)], "w string"), rules).collect()
    assert [(r.word, r.reasons) for r in found] == [("食べる", "-te")]
    file.write_text("て\tる\traw\tv9\t-te\n")
    with pytest.raises(ValueError, match="v9"):
        inflection.rules_of(text_files.rules(spark, f"file://{file}"))
