"""Stories as a stream: any split of the events into batches ends in the state that the batch operator gives."""

import json
import random

import pytest

from lexspan.operators import narrative
from lexspan.streaming import stories

SCHEMA = "story long, seq long, slot int, verb string, text string, ts timestamp"


def made(n, rng):
    return [{"story": rng.randint(1, 6), "seq": i, "slot": rng.randint(0, 4), "verb": rng.choice(["edit", "edit", "generate", "approve", "approve"]), "text": rng.choice(["", f"t{i}"]), "ts": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z"} for i in range(n)]


def streamed(spark, where, batches, **options):
    (where / "in").mkdir()
    for k, batch in enumerate(batches):
        (where / f"in/{k:03d}.json").write_text("".join(json.dumps(e) + "\n" for e in batch))
        events = spark.readStream.schema(SCHEMA).json(str(where / "in"))
        query = stories.run(events, str(where / "out"), str(where / "ck"), **options)
        query.awaitTermination()
        assert query.exception() is None
    return spark.read.parquet(str(where / "out"))


@pytest.mark.parametrize("how", ["in order", "shuffled and repeated"])
def test_any_split_equals_the_batch_operator(spark, tmp_path, how):
    rng = random.Random(len(how))
    events = made(200, rng)
    want = {tuple(r) for r in narrative.state(spark.createDataFrame([tuple(e.values())[:5] for e in events], "story long, seq long, slot int, verb string, text string")).collect()}
    sent = list(events)
    if how != "in order":
        sent += events[50:90]
        rng.shuffle(sent)
    edges = sorted(rng.sample(range(1, len(sent)), 3))
    batches = [sent[a:b] for a, b in zip([0, *edges], [*edges, len(sent)])]
    emitted = streamed(spark, tmp_path, batches)
    assert {tuple(r) for r in stories.newest(emitted).collect()} == want
    assert emitted.where("expired").count() == 0


def test_idle_stories_expire_and_begin_anew(spark, tmp_path):
    e = lambda story, seq, minute, verb="edit", text="x": {"story": story, "seq": seq, "slot": 0, "verb": verb, "text": text, "ts": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"}
    batches = [[e(1, 1, 0), e(2, 2, 1)], [e(2, 3, 25, text="y")], [e(2, 4, 50, "approve")], [e(3, 5, 51)], [e(1, 6, 52, "approve"), e(3, 7, 53)]]
    emitted = streamed(spark, tmp_path, batches, idle="30 minutes", late="1 minute")
    gone = {(r.story, r.text, r.approved) for r in emitted.where("expired").collect()}
    assert gone == {(1, "x", False)}
    last = {(r.story, r.slot): (r.text, r.approved) for r in stories.newest(emitted.where("not expired")).collect()}
    # The approval of story 1 came after it had been closed: it finds no text to approve.
    assert last[2, 0] == ("y", True) and last[3, 0] == ("x", False) and last[1, 0] == ("x", False)
