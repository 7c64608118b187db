from tastegrid.operators.onboarding import new_user_names, validate_new_users

USERS = "id int, username string"


def judge(frame, *names):
    requests = frame(list(enumerate(names)), "request_id long, username string")
    users = frame([(1, "existing")], USERS)
    return validate_new_users(requests, users)


def test_verdicts(frame):
    verdicts = judge(
        frame, "ab", "x" * 26, "existing", "newusername", "newusername", None, "   ", "abc", "y" * 25
    )
    got = [(r["accepted"], r["reason"]) for r in verdicts.orderBy("request_id").collect()]
    assert got == [
        (False, "length"), (False, "length"), (False, "registered"), (True, None),
        (False, "duplicate"), (False, "missing"), (False, "missing"), (True, None), (True, None),
    ]


def test_each_request_gets_one_verdict_when_one_name_is_hot(frame):
    verdicts = judge(frame, *(["hot name"] * 300 + [f"name {i}" for i in range(300)]))
    assert verdicts.count() == 600
    assert verdicts.where("accepted").count() == 301
    assert new_user_names(verdicts).distinct().count() == 301
