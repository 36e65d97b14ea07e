import pytest

from cairn.llm import pair_defects as P
from tests.llm.test_pair_defects import Q, ZQ, model, pairs  # noqa: F401

NOTE = "The data sheet lists the installation, the reading and the conditions of the trial in some detail. "
REFUSALS = [(Q, "I'm sorry, but I can't help with that request."), (Q, "I cannot provide details about the peak power."), (ZQ, "抱歉，我无法回答这个问题。")]


@pytest.mark.parametrize("times", [4, 10, 50])
def test_refusal_behind_a_long_preamble(model, times):  # noqa: F811
    for q, r in REFUSALS:
        assert P.judge(model, [q], [f"{q} " * times + r]) == ["refusal"]
    assert P.judge(model, [Q], [NOTE * times + REFUSALS[0][1]]) == ["refusal"]


@pytest.mark.parametrize("times", [4, 10, 50])
def test_long_sound_answers_stay_sound(model, times):  # noqa: F811
    for a in (f"{Q} " * times + "The peak power of Veltor AAA-100 is 12 kW.", NOTE * times + "The peak power of Veltor AAA-100 is 12 kW."):
        assert P.judge(model, [Q], [a]) == [None]
