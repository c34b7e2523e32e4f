"""Accounts, roles and permissions on schemas."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from papyrion.dialect.lexer import DialectError
from papyrion.sources.catalog import normal

ADMINISTRATORS = "administrators"


@dataclass(frozen=True)
class Rule:
    permission: str  # all, read, write or manage
    path: str
    role: str
    allowed: bool
    recursive: bool


@dataclass
class Policies:
    """Members of the role `Administrators` may do everything; others what a role is granted and none denied.

    A rule on a schema counts for those below if it is recursive. The nearest schema with a rule for
    the role decides; there a denial beats a grant, and over several roles one denial beats all grants.
    """

    accounts: dict[str, str] = field(default_factory=lambda: {"admin": ""})
    roles: dict[str, set[str]] = field(default_factory=lambda: {ADMINISTRATORS: {"admin"}, "default": set()})
    rules: list[Rule] = field(default_factory=list)

    def create_account(self, name: str, password: str) -> None:
        if name.lower() in self.accounts:
            raise DialectError(f"account {name!r} exists")
        salt = name.lower().encode()
        self.accounts[name.lower()] = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, 50_000).hex()
        self.roles["default"].add(name.lower())

    def drop_account(self, name: str) -> None:
        self._account(name)
        del self.accounts[name.lower()]
        for members in self.roles.values():
            members.discard(name.lower())

    def create_role(self, name: str) -> None:
        if name.lower() in self.roles:
            raise DialectError(f"role {name!r} exists")
        self.roles[name.lower()] = set()

    def drop_role(self, name: str) -> None:
        self._role(name)
        del self.roles[name.lower()]
        self.rules = [r for r in self.rules if r.role != name.lower()]

    def member(self, role: str, account: str, add: bool) -> None:
        self._role(role)
        self._account(account)
        (self.roles[role.lower()].add if add else self.roles[role.lower()].discard)(account.lower())

    def rule(self, permission: str, path: str, role: str, allowed: bool, recursive: bool) -> None:
        self._role(role)
        self.revoke(permission, path, role)
        self.rules.append(Rule(permission, normal(path), role.lower(), allowed, recursive))

    def revoke(self, permission: str, path: str, role: str) -> None:
        self._role(role)
        self.rules = [r for r in self.rules if not (r.path == normal(path) and r.role == role.lower() and permission in ("all", r.permission))]

    def roles_of(self, account: str) -> list[str]:
        return sorted(r for r, members in self.roles.items() if account.lower() in members)

    def deciding(self, account: str, path: str) -> list[Rule]:
        """Per role of the account the rules that hold on the schema."""
        out = []
        for role in self.roles_of(account):
            at, below = normal(path), False
            while True:
                if here := [r for r in self.rules if r.role == role and r.path == at and (r.recursive or not below)]:
                    out += here
                    break
                if not at:
                    break
                at, below = at.rpartition(":")[0], True
        return out

    def allows(self, account: str, permission: str, path: str) -> bool:
        if account.lower() in self.roles[ADMINISTRATORS] or normal(path) == "single":
            return True
        rules = [r for r in self.deciding(account, path) if r.permission in ("all", permission)]
        return any(r.allowed for r in rules) and all(r.allowed for r in rules)

    def _role(self, name: str) -> None:
        if name.lower() not in self.roles:
            raise DialectError(f"no role {name!r}")

    def _account(self, name: str) -> None:
        if name.lower() not in self.accounts:
            raise DialectError(f"no account {name!r}")
