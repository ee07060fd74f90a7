"""Paths that connections and DNS answers share."""

from signalloom.operators import topology

NAMES = "host string, namespace string, pod_uid string, pod_name string, container_name string, container_id string"


def test_connections_and_answers_of_one_path(spark):
    who = ("h", "n", "u", "p", "c", "k")
    opens = spark.createDataFrame([(*who, "10.0.0.1", 80, "tcp", "db", ts, seq) for ts, seq in ((10, 0), (20, 2), (15, 3), (40, 6))], NAMES + ", remote_address string, remote_port int, protocol string, destination_owner string, ts long, seq long")
    answers = spark.createDataFrame([(*who, "db", "no_error", ts, seq) for ts, seq in ((10, 1), (20, 4), (30, 5), (30, 7))] + [(*who, "x", "no_error", 5, 8), (*who, "x", "no_error", 5, 9), (*who, "x", "nx_domain", 6, 10)], NAMES + ", domain string, response_code string, ts long, seq long")
    got = {r.destination_label: (r.observations, r.first_seen, r.last_seen) for r in topology.observed_paths(opens, answers).collect()}
    # db: 1 at 10; the answer at 10 has the last time; 2 at 20; 15 extends nothing; the answer at 20 doesn't count; 3 at 30; the edge's third (40) leaves 3; the answer at 30 adds one
    assert got == {"db": (4, 10, 40), "x": (1, 5, 5)}


def test_paths_without_connections(spark):
    answers = spark.createDataFrame([(None, None, None, None, None, None, "x", "no_error", 5, 1)], NAMES + ", domain string, response_code string, ts long, seq long")
    opens = spark.createDataFrame([], NAMES + ", remote_address string, remote_port int, protocol string, ts long, seq long")
    assert [(r.host, r.path_label, r.observations) for r in topology.observed_paths(opens, answers).collect()] == [(None, "unknown->x", 1)]


def test_mixed_paths_equal_a_plain_loop(spark):
    import random

    rng = random.Random(3)
    rows = []
    for k in range(300):
        answer = rng.random() < 0.5
        high = rng.randrange(40)
        rows.append((rng.choice(["h", None]), rng.choice(["a->b", "a->c"]), k // 2, int(answer), 1 if answer else rng.randrange(1, 30), high if answer else rng.randrange(high + 1), high, "a", "d"))
    rows = list({(r[0], r[1], r[2], r[3]): r for r in rows}.values())  # one of each place in the order
    df = spark.createDataFrame(rows, "host string, path_label string, seq long, _answer int, _count long, _low long, _high long, source_label string, destination_label string")
    want = {}
    for host, path, _, answer, count, low, high, *_ in sorted(rows, key=lambda r: (r[2], r[3])):
        now = want.get((host, path))
        if now is None:
            want[host, path] = (count, low, high)
            continue
        n = (now[0] + (high != now[2])) if answer else max(now[0], count)
        want[host, path] = (n, min(now[1], low), max(now[2], high))
    assert {(r.host, r.path_label): (r.observations, r.first_seen, r.last_seen) for r in topology._mixed(df).collect()} == want
