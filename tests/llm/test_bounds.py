"""What the driver holds is bounded: benchmarks of many blocks, labelled texts of many bytes."""

from pyspark import Broadcast

from skerry.llm import decontaminate, mil


def test_benchmark_of_many_blocks_is_held_block_by_block(spark, monkeypatch):
    items = [(k, " ".join(f"{'abcdefghij'[(k * 7 + j) % 10]}{k}word{(k * j) % 13}" for j in range(12))) for k in range(60)]
    bench = spark.createDataFrame([*items, (60, None), (61, "  "), (3, items[3][1])], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {items[k % 60][1].upper()}\nafter" if k % 3 else f"clean text {k}", k) for k in range(90)] + [(90, None, 1)], "doc_id long, text string, more int")
    alive, most, made = set(), [0], [0]
    first, last = type(spark.sparkContext).broadcast, Broadcast.destroy

    def begin(context, value):
        out = first(context, value)
        alive.add(id(out))
        made[0] += 1
        most[0] = max(most[0], len(alive))
        return out

    def end(self, *args):
        alive.discard(id(self))
        return last(self, *args)

    one = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    kept = sorted((tuple(r) for r in decontaminate.clean_documents(docs, bench).collect()), key=repr)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", begin)
    monkeypatch.setattr(Broadcast, "destroy", end)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench, block_bytes=600).collect())) == one and len(one) == 60
    assert made[0] > 8 and most[0] == 1 and not alive
    many = decontaminate.clean_documents(docs, bench, block_bytes=2_000)
    assert sorted((tuple(r) for r in many.collect()), key=repr) == kept and len(kept) == 31
    assert most[0] == 1 and many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0


def test_fit_takes_whole_texts_within_its_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mil, "fit", lambda bags, labels, seed: seen.append(sorted(len(b) for b in bags)))
    word = "abc " * 64  # 256 bytes, one passage
    docs = spark.createDataFrame([(k, word * (1 + k % 3)) for k in range(30)] + [(30, word * 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(31)], "doc_id long, quality int")
    mil.train(docs, labels, held_out=9)
    mil.train(docs, labels, held_out=9, sample_bytes=256 * 50)
    assert len(seen[0]) == 31 and seen[0][-1] == 40
    assert 45 < sum(seen[1]) <= 50 and seen[1][-1] == 3
