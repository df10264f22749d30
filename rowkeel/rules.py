"""Audit rules: what refers to what, and what a missing value means."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass


@dataclass(frozen=True)
class FkRule:
    """Values of child.column should be values of ref.column."""

    rule_id: str
    child_table: str
    child_column: str
    ref_table: str
    ref_column: str
    note: str = ""


@dataclass(frozen=True)
class CardinalityRule:
    """How many children, by their fk, the keys of a parent have; `declared` is only reported."""

    rule_id: str
    parent_table: str
    parent_column: str
    child_table: str
    child_column: str
    declared: str = "1 → N"


@dataclass(frozen=True)
class NullMeaning:
    """table.column, or *.column for any table, and what null means there."""

    pattern: str
    meaning: str

    @property
    def table(self) -> str:
        return self.pattern.partition(".")[0]

    @property
    def column(self) -> str:
        return self.pattern.partition(".")[2]


def parse_fk_rules(text: str) -> list[FkRule]:
    """Lines `id child/table.column -> ref/table.column  # note`."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        body, _, note = line.partition("#")
        rule_id, child, _, ref = body.split()
        ct, _, cc = child.rpartition(".")
        rt, _, rc = ref.rpartition(".")
        out.append(FkRule(rule_id, ct, cc, rt, rc, note.strip()))
    return _unique(out)


def parse_cardinality_rules(text: str) -> list[CardinalityRule]:
    """Lines `id parent/table.pk declared child/table.fk`, declared 1:N or N:N."""
    out = []
    for line in filter(None, map(str.strip, text.splitlines())):
        rule_id, parent, declared, child = line.split()
        pt, _, pc = parent.rpartition(".")
        ct, _, cc = child.rpartition(".")
        out.append(CardinalityRule(rule_id, pt, pc, ct, cc, {"1:N": "1 → N", "N:N": "N ↔ N"}[declared]))
    return _unique(out)


def _unique(rules: list) -> list:
    if len({r.rule_id for r in rules}) < len(rules):
        raise ValueError("rule ids must be unique")
    return rules


# The rules of the three enterprise systems.
ENTERPRISE_FK = parse_fk_rules(
    """
    FK01 ERP/customers.account_id -> CRM/accounts.account_id
    FK02 RH/projects.client_account_id -> CRM/accounts.account_id
    FK03 CRM/opportunities.owner_id -> RH/employees.employee_id
    FK04 ERP/sales_orders.sales_rep_id -> RH/employees.employee_id
    FK05 ERP/purchase_orders.approved_by -> RH/employees.employee_id
    FK06 RH/departments.manager_id -> RH/employees.employee_id # auto-ref
    FK07 ERP/products.supplier_id -> ERP/suppliers.supplier_id
    FK08 ERP/sales_orders.customer_id -> ERP/customers.customer_id
    FK09 ERP/invoices.customer_id -> ERP/customers.customer_id
    FK10 ERP/invoices.order_id -> ERP/sales_orders.order_id
    FK11 ERP/order_lines.order_id -> ERP/sales_orders.order_id
    FK12 ERP/order_lines.product_id -> ERP/products.product_id
    FK13 ERP/payments.invoice_id -> ERP/invoices.invoice_id
    FK14 ERP/po_lines.po_id -> ERP/purchase_orders.po_id
    FK15 ERP/po_lines.product_id -> ERP/products.product_id
    FK16 RH/employee_projects.employee_id -> RH/employees.employee_id
    FK17 RH/employee_projects.project_id -> RH/projects.project_id
    FK18 RH/timesheets.employee_id -> RH/employees.employee_id
    FK19 RH/timesheets.project_id -> RH/projects.project_id
    FK20 RH/skills.employee_id -> RH/employees.employee_id
    FK21 RH/leave_requests.employee_id -> RH/employees.employee_id
    FK22 RH/performance_reviews.employee_id -> RH/employees.employee_id
    """
)
ENTERPRISE_CARDINALITY = parse_cardinality_rules(
    """
    C01 RH/departments.department_id 1:N RH/employees.department_id
    C02 RH/employees.employee_id 1:N RH/skills.employee_id
    C03 RH/employees.employee_id 1:N RH/leave_requests.employee_id
    C04 RH/employees.employee_id 1:N RH/performance_reviews.employee_id
    C05 RH/employees.employee_id 1:N RH/timesheets.employee_id
    C06 RH/employees.employee_id N:N RH/employee_projects.employee_id
    C07 RH/projects.project_id N:N RH/employee_projects.project_id
    C08 RH/projects.project_id 1:N RH/project_milestones.project_id
    C09 CRM/accounts.account_id 1:N CRM/contacts.account_id
    C10 CRM/accounts.account_id 1:N CRM/opportunities.account_id
    C11 CRM/accounts.account_id 1:N CRM/revenue_history.account_id
    C12 CRM/contacts.contact_id 1:N CRM/activities.contact_id
    C13 ERP/customers.customer_id 1:N ERP/sales_orders.customer_id
    C14 ERP/sales_orders.order_id 1:N ERP/order_lines.order_id
    C15 ERP/sales_orders.order_id 1:N ERP/invoices.order_id
    C16 ERP/suppliers.supplier_id 1:N ERP/products.supplier_id
    C17 ERP/suppliers.supplier_id 1:N ERP/purchase_orders.supplier_id
    C18 ERP/purchase_orders.po_id 1:N ERP/po_lines.po_id
    C19 ERP/invoices.invoice_id 1:N ERP/payments.invoice_id
    C20 ERP/products.product_id 1:N ERP/inventory.product_id
    """
)
ENTERPRISE_NULLS = [
    NullMeaning("employees.manager_id", "top manager"),
    NullMeaning("*.notes", "no comment"),
    NullMeaning("milestones.actual_cost", "milestone not finished"),
    NullMeaning("recruitment.actual_hire_date", "position unfilled"),
    NullMeaning("*.lost_reason", "deal not lost"),
]


def edges(rules: Iterable[FkRule]) -> list[tuple[str, str]]:
    """(child table, referenced table) of each rule."""
    return [(r.child_table, r.ref_table) for r in rules]
