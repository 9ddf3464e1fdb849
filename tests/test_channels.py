"""Channel ends by their names."""

from graphloom.operators import matching


def test_names_that_stand_for_an_end(spark):
    declared = spark.createDataFrame([(1, "tx", "rx"), (1, "tx", "rx"), (1, "a_b", "c"), (2, "jobs", "out")], "file_id long, tx string, rx string")
    ends = [
        (1, "s1", "send", "tx"), (1, "s2", "send", "tx.clone"), (1, "s3", "send", "tx_2"), (1, "s4", "send", "self.tx"), (1, "s5", "send", "txt"), (1, "s6", "send", "mytx"), (1, "s7", "send", "a_b.x"), (1, "s8", "send", "x.y"),
        (1, "r1", "recv", "rx"), (1, "s1", "recv", "rx_3"), (1, "r2", "recv", "c"), (1, "r3", "recv", "prx"),
        (2, "p", "send", "jobs_a"), (2, "q", "recv", "self.out"), (2, "p", "recv", "out"), (2, "z", "send", "sender"), (3, "m", "send", "the_sender"), (3, "n", "recv", "a_receiver"), (3, "m", "recv", "rx"), (1, None, "send", None), (1, "e", "send", ""),
    ]
    got = {tuple(r) for r in matching.sends_to(declared, spark.createDataFrame(ends, "file_id long, scope string, role string, var string")).collect()}
    named = {(1, s, r) for s in ("s1", "s2", "s3", "s4") for r in ("r1", "s1") if s != r} | {(1, "s7", "r2"), (2, "p", "q")}
    # Not the very name of a declared end, but like a sender's: to all receives that are like a receiver's.
    guessed = {(1, s, r) for s in ("s2", "s3", "s4", "s5", "s6") for r in ("r1", "s1", "r3") if s != r} | {(3, "m", "n")}
    assert got == named | guessed
    assert matching.sends_to(declared.limit(0), spark.createDataFrame([], "file_id long, scope string, role string, var string")).count() == 0
