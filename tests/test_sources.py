"""Message files of both forms, read back whole."""

import json
import random

import pytest


def test_read_messages_of_both_forms(spark, tmp_path):
    from convmem.sources.tables import read_messages

    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").limit(60).collect()
    messages = [{"scope": f"g{r['conv_id'] % 3}", "event": {"id": f"{r['conv_id']}-{r['turn']}", "speaker": r["role"], "text": r["text"]}} for r in rows]
    assert len(messages) == 60
    (tmp_path / "a one.json").write_text("\n" + json.dumps(messages[:20], indent=1))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, messages[20:40])))
    (tmp_path / "c.json").write_text("".join(json.dumps(m) + "\n" for m in messages[40:]))
    (tmp_path / "d.json").write_text("")
    got = [(r["scope"], r["id"], r["text"]) for r in read_messages(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((m["scope"], m["event"]["id"], m["event"]["text"]) for m in messages)


def _awkward(n: int) -> list[dict]:
    """Messages whose texts hold braces, brackets, quotes and backslashes, and are from empty to long."""
    dice = random.Random(5)
    bits = ["{", "}", "[", "]", '"', "\\", ",", "\n", "é", "𝄞", " ", "word", '\\"', "}}", "{{", '"},{"']
    return [{"scope": f"g{i % 3}", "event": {"id": str(i), "text": "".join(dice.choices(bits, k=dice.choice([0, 1, 5, 40, 400, 3000 if i % 50 == 0 else 3])))}} for i in range(n)]


@pytest.mark.parametrize("limit", [500_000, 0])
@pytest.mark.parametrize("size", [7, 4096])
def test_array_files_are_read_in_splits(spark, tmp_path, size, limit):
    from pyspark.sql import functions as F

    from convmem.sources.arrays import array_elements

    messages = _awkward(300)
    texts = {"a.json": json.dumps(messages[:200]), "b.json": "\n [\n" + ",\n".join(json.dumps(m, indent=2, ensure_ascii=False) for m in messages[200:]) + "\n]\n\n", "empty.json": "[ ]"}
    if size == 7:
        texts = {"a.json": '[{"a":"}{\\"","b":{"c":1}},{"d":"\\\\\\\\"},{"e":"][', "one.json": json.dumps(messages[4:5])[:60]}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    # What a plain reader takes out of each file: whole objects, and what is left of a broken file as one text.
    want = []
    for text in texts.values():
        text = text.strip().removeprefix("[")
        while text := text.lstrip(" ,\n"):
            try:
                value, at = json.JSONDecoder().raw_decode(text)
                want.append(json.dumps(value, sort_keys=True))
                text = text[at:]
            except ValueError:
                want += [text] if text.strip("] \n") else []
                break
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        files = [r["file"] for r in spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("file")).distinct().collect()]
        if size == 4096:
            assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 9
        got = [r["text"] for r in array_elements(spark, str(tmp_path), files, limit).collect()]
    finally:
        for k in keys:
            spark.conf.unset(k)

    def same(text):
        try:
            return json.dumps(json.loads(text), sort_keys=True)
        except ValueError:
            return text

    assert sorted(map(same, got)) == sorted(want)


def test_a_string_over_many_splits(spark, tmp_path):
    """One message far longer than a split, whose text is all braces and quotes."""
    from convmem.sources.tables import read_messages

    text = '}{"' * 3000
    messages = [{"scope": "a", "event": {"id": "1", "text": text}}, {"scope": "b", "event": {"id": "2", "text": "x"}}]
    (tmp_path / "m.json").write_text(json.dumps(messages))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = {r["scope"]: r["text"] for r in read_messages(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"a": text, "b": "x"}
