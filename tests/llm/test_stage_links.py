"""The stage that keeps one of near-duplicates links by fingerprints and the pigeonring, too."""

from pyspark.sql import functions as F

from cuelake.llm import simhash


def test_fingerprints_link_what_sketches_miss(spark):
    words = [f"w{i * 7919 % 10007}" for i in range(400)]
    near = [*words[:-2], "other", "end"]
    assert bin(simhash.simhash(" ".join(words), 5) ^ simhash.simhash(" ".join(near), 5)).count("1") <= simhash.MOST_BITS
    unlike = [f"v{i * 7919 % 10007}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(unlike)), (4, "")], "doc_id long, text string")
    nodes = simhash.text_nodes(docs)
    nodes = nodes.withColumn("sketch", F.unhex(F.concat(*[F.sha2(F.concat(F.hex("digest"), F.lit(str(i))), 512) for i in range(2)])))
    nodes = nodes.withColumn("fp", F.when(F.col("doc_id") == 3, F.lit(0).cast("long")).otherwise(F.col("fp")))  # as the empty text's, which is unlike
    comps = simhash.similar_texts(docs, nodes).join(nodes, "node")
    assert [sorted(r.ids) for r in comps.groupBy("component").agg(F.collect_list("doc_id").alias("ids")).collect()] == [[1, 2]]
