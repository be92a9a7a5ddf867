"""Egress policy: what may be written where.

A target is inside if its scheme is one of the cluster's own stores; any other scheme, also an
unknown one, leaves the cluster. Rows leave only if the policy declares them made up, and never from
a workspace with participants' data, which an environment variable marks.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import urlsplit


class EgressRefused(PermissionError):
    """The policy does not let these rows go to this target."""


@dataclass(frozen=True)
class Egress:
    made_up_rows: bool = False
    inside: frozenset[str] = frozenset({"", "file", "hdfs", "viewfs"})
    # Fixed value: the variable that marks such a workspace.
    workspace_variable: str = "WORKSPACE_CDR"

    def leaves(self, target: str) -> bool:
        return urlsplit(str(target)).scheme.lower() not in self.inside

    def admit(self, target: str) -> None:
        """Raise unless rows may be written to ``target``; call it before any work."""
        if not self.leaves(target):
            return
        reasons = []
        if os.environ.get(self.workspace_variable):
            reasons.append(f"{self.workspace_variable} marks this as a workspace with real data")
        if not self.made_up_rows:
            reasons.append("the rows are not declared as made up")
        if reasons:
            raise EgressRefused(f"{target} is outside the cluster: {'; '.join(reasons)}")


CLOSED = Egress()
