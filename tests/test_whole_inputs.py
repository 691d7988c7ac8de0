from veridex.plans import registry

SF = "/root/testdata/sf0.01"


def test_greedy_unique_takes_all_of_part(spark, tmp_path):
    rows = [(i, f"name{i % 700}", f"brand{i // 40}") for i in range(1, 1201)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    names, brands, want = set(), set(), []
    for i, name, brand in rows:
        if name not in names and brand not in brands:
            names.add(name)
            brands.add(brand)
            want.append(i)
    got = [r.p_partkey for r in registry.QUERIES["t13_greedy_unique"](spark, str(tmp_path)).collect()]
    assert sorted(got) == want and max(want) > 400


def test_fuzzy_names_takes_queries_from_all_of_part(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").filter("p_partkey % 50 = 0").collect()
    got = registry.QUERIES["f11_j17_fuzzy_names"](spark, SF).select("query").distinct().collect()
    assert {r.query for r in got} == {r.p_name.lower() + "s" for r in part} and len(part) > 10
