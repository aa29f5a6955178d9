"""A CSV file is read by many tasks unless quoted line breaks forbid it."""

from briskbi.sources import files


def test_only_quoted_line_breaks_need_one_task(spark, tmp_path):
    plain, broken, odd = (tmp_path / f"{n}.csv" for n in ("plain", "broken", "odd"))
    n = 4000
    plain.write_text("k,v\n" + "".join(f'{i},"say ""{i}"", twice"\n' for i in range(n)))
    broken.write_text("k,v\n" + "".join(f'{i},"line {i}\n and more, ""quoted"""\n' for i in range(n)))
    odd.write_bytes(b"k,v\n" + b"".join(b'%d,caf\xe9 5" pipe\n' % i for i in range(3)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = files.read_any(spark, [str(plain), str(broken), str(odd)])
        a, b, c = got.frames
        assert a.rdd.getNumPartitions() > 3 and b.rdd.getNumPartitions() == 1
        assert sorted((int(r.k), r.v) for r in a.collect()) == [(i, f'say "{i}", twice') for i in range(n)]
        assert sorted((int(r.k), r.v) for r in b.collect()) == [(i, f'line {i}\n and more, "quoted"') for i in range(n)]
        assert {r.v for r in c.collect()} == {'café 5" pipe'}
        assert files.judge_text(spark, str(plain), "UTF-8") == ("UTF-8", False)
        assert files.judge_text(spark, str(odd), "UTF-8") == ("windows-1252", True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
