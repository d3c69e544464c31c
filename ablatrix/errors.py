"""Typed refusals.  A reason is a fixed word; exit_code is what a command line would return."""


class Refusal(Exception):
    exit_code = 2

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


class InvalidConfiguration(Refusal):
    exit_code = 3


class InvalidEvidence(Refusal):
    exit_code = 4


class BudgetExceeded(Refusal):
    exit_code = 5
