"""Element identity: the best locator, a coarse fingerprint and the rank of the rule that gives the locator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.text import string_literal, truncate
from pathloom.functions.url import present
from pathloom.schema import STRUCTURAL_ROLES


class _Signals:
    def __init__(self, target: str | Column):
        t = F.col(target) if isinstance(target, str) else target
        s, attributes = t["selectors"], t["attributes"]
        self.target = t
        self.role, self.name = present(s["role"]["role"]), present(s["role"]["name"])
        self.testid = F.coalesce(present(s["testid"]), present(F.try_element_at(attributes, F.lit("data-testid"))))
        self.aria = present(F.try_element_at(attributes, F.lit("aria-label")))
        self.placeholder, self.css = present(s["placeholder"]), present(s["css"])
        self.tag, self.text = present(t["tag"]), present(t["text_content"])
        self.structural = self.role.isin(STRUCTURAL_ROLES)
        self.has_text = self.tag.isin("BUTTON", "A", "LABEL") & (F.length(self.text) <= 50)


def _call(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}("), string_literal(value), F.lit(")"))


def locator(target: str | Column = "target") -> Column:
    """The most stable locator of a target, null if it has none."""
    s = _Signals(target)
    return F.coalesce(
        F.when(s.role.isNotNull() & s.name.isNotNull(), F.concat(F.lit("getByRole("), string_literal(s.role), F.lit(", { name: "), string_literal(truncate(s.name)), F.lit(" })"))),
        F.when(s.structural, _call("getByRole", s.role)),
        F.when(s.testid.isNotNull(), _call("getByTestId", s.testid)),
        F.when(s.aria.isNotNull(), _call("getByLabel", truncate(s.aria))),
        F.when(s.placeholder.isNotNull(), _call("getByPlaceholder", truncate(s.placeholder))),
        F.when(s.has_text, _call("getByText", truncate(s.text))),
        F.when(s.css.isNotNull(), _call("locator", s.css)),
        F.when(s.tag.isNotNull(), _call("locator", F.lower(s.tag))),
    )


def fingerprint(target: str | Column = "target") -> Column:
    """Coarse identity of a target: tag, role, name, test id and css that are there, joined by |."""
    s = _Signals(target)
    name = F.when(s.role.isNotNull(), F.trim(F.regexp_replace(s.name, r"(?U)\s+", " ")))
    return F.concat_ws("|", F.upper(s.tag), F.concat(F.lit("role:"), s.role), F.concat(F.lit("name:"), name), F.concat(F.lit("testid:"), s.testid), F.concat(F.lit("css:"), s.css))


def priority(target: str | Column = "target") -> Column:
    """1 to 7: which rule gives the locator; 99 for none."""
    s = _Signals(target)
    return (
        F.when(s.role.isNotNull() & (s.name.isNotNull() | s.structural), 1).when(s.testid.isNotNull(), 2).when(s.aria.isNotNull(), 3).when(s.placeholder.isNotNull(), 4)
        .when(s.has_text, 5).when(s.css.isNotNull(), 6).when(s.tag.isNotNull(), 7).otherwise(99)
    )


def identity(element: str | Column) -> Column:
    """What tells elements of a snapshot apart: test id, else role and name, else css or tag."""
    s = _Signals(element)
    direct = present(s.target["selectors"]["testid"])
    return F.coalesce(F.concat(F.lit("testid:"), direct), F.concat(F.lit("role:"), s.role, F.lit(":"), F.coalesce(s.name, F.lit(""))), F.concat(F.lit("css:"), F.coalesce(s.css, s.tag, F.lit(""))))


def snapshot_locator(element: str | Column) -> Column:
    """Locator of a snapshot's element by role and name, test id or short text, else null."""
    s = _Signals(element)
    direct = present(s.target["selectors"]["testid"])
    return F.concat(F.lit("page."), F.coalesce(
        F.when(s.role.isNotNull() & s.name.isNotNull(), F.concat(F.lit("getByRole("), string_literal(s.role), F.lit(", { name: "), string_literal(truncate(s.name)), F.lit(" })"))),
        F.when(direct.isNotNull(), _call("getByTestId", direct)),
        F.when(F.length(s.text) <= 50, _call("getByText", s.text)),
    ))
