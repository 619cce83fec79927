import random

#: Texts that every document operator must stand: nulls, blanks, ties, copies, long and odd ones.
def odd_rows():
    rng = random.Random(3)
    words = [f"w{rng.randrange(400)}x{i % 7}" for i in range(900)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " ", "\n\n", "one", "Ünïcode ▁ mark\ttab  nbsp", "a" * 150, "ab " * 300, passage, passage, body(80) + " " + passage, passage + " " + body(40), body(3000), "漢字😀 " * 40, "x\n" * 30 + "y", body(100), body(100).upper()]
    texts += [body(200)] * 3
    near = body(300).split()
    for i in range(6):
        copy = list(near)
        copy[i * 7] = "changed"
        texts.append(" ".join(copy))
    rows = [(i, t, f"src{i % 4}" if i % 5 else None) for i, t in enumerate(texts)]
    rows += [(None, "no id here " * 10, "src1"), (8, passage, "src2"), (15, texts[15], "src3"), (15, texts[15], "src3")]
    return rows


SCHEMA = "doc_id long, text string, source string"


def odd(spark, parts=3):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(parts).withColumn("n", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
