"""Predicates and classes of symbol names, mnemonics and operands, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BAD_PREFIXES = ("$", ".L", ".__", "@", "__thumb$")
GOOD_WORDS = ("main", "init", "handler", "isr", "task", "function", "interrupt")
NOT_FUNCTIONS = ("$", ".L", "__", "@")
BRANCHES = ("B", "BL", "BX", "BEQ", "BNE", "BPL", "BMI", "BCC", "BCS", "BHS", "BLO", "BVS", "BVC", "BHI", "BLS", "BGE", "BGT", "BLE", "BLT")
CLASSES = (("BR", ("B", "BL", "BX", "BLX", "CBZ", "CBNZ")), ("ALU", ("ADD", "ADC", "SUB", "SBC", "RSB", "MUL", "MLA")), ("MOV", ("MOV", "MVN")), ("CMP", ("CMP", "CMN", "TST", "TEQ")), ("STACK", ("PUSH", "POP", "STM", "LDM")))
#: What of operands is replaced, in this order: a comment, an immediate, another address, white space.
OPERAND_RULES = ((r";[\s\S]*$", ""), (r"#-?(0x[0-9a-fA-F]+|[0-9]+)", "#IMM"), (r"0x[0-9a-fA-F]+", "IMM"), (r"\s+", " "))


def starts(name: Column, prefixes: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in prefixes:
        found = found | name.startswith(p)
    return found


def good_symbol(name: Column) -> Column:
    """Whether a symbol is worth keeping; null and empty names are not."""
    return F.coalesce(F.when(name == "", False).when(name.startswith("??"), True).when(starts(name, BAD_PREFIXES), False).when(F.lower(name).rlike("|".join(GOOD_WORDS)), True).otherwise(F.length(name) >= 2), F.lit(False))


def function_like(name: Column) -> Column:
    return F.coalesce(~starts(name, NOT_FUNCTIONS), F.lit(False))


def mnemonic_class(mnemonic: Column) -> Column:
    """Coarse class of a mnemonic by its leading letters; itself where there is no class."""
    up = F.upper(mnemonic)
    base = F.when(up.rlike("^[A-Z]"), F.regexp_extract(up, "^[A-Z]+", 0)).otherwise(up)
    out = F.when(base.isin(*CLASSES[0][1]), CLASSES[0][0]).when(base.startswith("LDR"), "LDR").when(base.startswith("STR"), "STR")
    for name, members in CLASSES[1:]:
        out = out.when(base.isin(*members), name)
    return out.when(base.rlike("^[VF]"), "FP").otherwise(base)


def operand_text(operands: Column) -> Column:
    """Operands without comment, immediates as IMM, single spaces."""
    text = operands
    for pattern, to in OPERAND_RULES:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def norm_site(mnemonic: Column, operands: Column, lo: int, hi: int) -> Column:
    """'branch', 'ptr' or null for an instruction or data line: branches; DC* of a symbol or of an address in [lo, hi];
    LDR and ADR of a symbol (a name that is no register) or of a PC-relative literal whose comment has an address."""
    up = F.upper(mnemonic)
    value = F.conv(F.regexp_extract(operands, "0x([0-9a-fA-F]+)", 1), 16, 10).cast("long")
    bare = F.regexp_replace(F.regexp_replace(operands, ";.*$", ""), "0x[0-9a-fA-F]+", "")
    symbol = F.regexp_replace(bare, r"(?i)\b(r[0-9]+|sp|lr|pc|ip|fp)\b", "").rlike(r"[A-Za-z_?]")
    return F.when(up.isin(*BRANCHES), "branch").when(up.startswith("DC") & (bare.rlike("[A-Za-z]") | value.between(lo, hi)), "ptr").when(up.isin("LDR", "ADR") & (symbol | (operands.contains("[PC") & operands.contains("; 0x"))), "ptr")
