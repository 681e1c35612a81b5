"""Several vectors of one id, all of which are searched."""

from paperloom.llm import neighbours


def found(spark, data):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.search(df).collect())


def test_the_nearest_vector_of_an_id_is_found(spark):
    assert found(spark, [(1, [0.5, 0.1]), (1, [9.0, 0.0]), (20, [1.0, 0.0])]) == [(20, 1, 1, 9.0), (20, 2, 1, 0.5)]


def test_a_query_id_with_two_vectors_asks_twice(spark):
    got = found(spark, [(20, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (3, [1.0, 1.0])])
    assert got == [(20, 1, 3, 1.0), (20, 1, 3, 2.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0)]


def test_one_id_on_all_rows(spark):
    data = [(20, [float(i), 1.0]) for i in range(50)]
    got = found(spark, data)
    assert len(got) == 50 * 20 and {v for _, _, v, _ in got} == {20}
    want = sorted((sorted((float(a * b + 1) for b in range(50) if a != b), reverse=True)[:20]) for a in range(50))
    ranks = sorted(score for _, rank, _, score in got if rank == 1)
    assert ranks == sorted(w[0] for w in want)
