"""Prompt texts and the expressions that fill them in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from instructset.functions.text import strip

# The prompt texts, separators and special tokens.
DESCRIPTION_PROMPT = (
    "Act as an e-commerce expert. Given a product title, generate a description for the product.\nTitle: "
)
QUESTION_PROMPT = (
    "Act as an e-commerce expert. Answer the following question based on the context. "
)
SUMMARY_PROMPT = "Act as an e-commerce expert. Summarize the following product reviews.\n"
INSTRUCTION_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n%s\n\n### Input:\n%s\n\n### Response:"
)
INSTRUCTION_ONLY = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
    "### Instruction:\n%s\n\n### Response:"
)
TRAINING_SEPARATOR = " <SEP> "
GENERATION_SEPARATOR = "<SEP>"
PAD_TOKEN = "[PAD]"
EOS_TOKEN = "</s>"
UNK_TOKEN = "<unk>"


def _fill(template: str, *values: Column) -> Column:
    """``template`` with each ``%s`` replaced; null as soon as one value is null."""
    texts = [F.lit(text) for text in template.split("%s")]
    parts = [texts[0]]
    for value, text in zip(values, texts[1:]):
        parts += [value, text]
    return F.concat(*parts)


def product_prompt(title: Column, brand: Column, color: Column, bullets: Column) -> Column:
    """Missing brand or colour shows as the word ``None``."""
    return _fill(
        "Title: %s\nBrand: %s\nColor: %s\nBullet points: %s",
        title,
        F.coalesce(brand, F.lit("None")),
        F.coalesce(color, F.lit("None")),
        bullets,
    )


def instruction_prompt(instruction: Column, context: Column | None = None) -> Column:
    """The two-part template where ``context`` is not null, else the short one."""
    short = _fill(INSTRUCTION_ONLY, instruction)
    if context is None:
        return short
    return F.when(
        context.isNotNull(), _fill(INSTRUCTION_WITH_INPUT, instruction, context)
    ).otherwise(short)


def question_prompt(question: Column, context: Column) -> Column:
    return _fill(QUESTION_PROMPT + "\nQuestion: %s\nContext: %s", question, context)


def summary_prompt(reviews: Column) -> Column:
    return F.concat(F.lit(SUMMARY_PROMPT), reviews)


def description_prompt(title: Column) -> Column:
    return F.concat(F.lit(DESCRIPTION_PROMPT), title)


def prefixed(text: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), text)


def without_prompt(text: Column, prompt: str = SUMMARY_PROMPT) -> Column:
    """The text between the first and the second prompt; null where there is none."""
    return F.get(F.split(text, r"\Q" + prompt + r"\E"), F.lit(1))


def training_text(prompt: Column, response: Column, eos: str = EOS_TOKEN) -> Column:
    return F.concat(prompt, response, F.lit(eos))


def system_prompt(system: Column, instruction: Column) -> Column:
    return F.concat(system, F.lit("\n\n"), instruction_prompt(instruction))


def mixed_prompt(marker: Column, system: Column, prompt: Column) -> Column:
    """The part of a mixed row that is given; pretraining rows have none."""
    return F.when(marker == 0, system_prompt(system, strip(prompt))).otherwise(F.lit(""))


def mixed_text(
    marker: Column,
    system: Column,
    prompt: Column,
    response: Column,
    eos: str = EOS_TOKEN,
    prompt_only: bool = False,
) -> Column:
    """Plain text for pretraining rows, the filled template for instruction rows."""
    given = system_prompt(system, strip(prompt))
    taught = given if prompt_only else F.concat(given, strip(response), F.lit(eos))
    return F.when(marker == 1, F.concat(strip(prompt), F.lit(eos))).otherwise(taught)


def training_line(prompt: Column, response: Column, separator: str = TRAINING_SEPARATOR) -> Column:
    return F.concat(prompt, F.lit(separator), response)


def generation_prompt(prompt: Column, separator: str = GENERATION_SEPARATOR) -> Column:
    return F.concat(prompt, F.lit(separator))


def without_echo(generated: Column, prompt: Column) -> Column:
    """Generated text with every copy of its prompt removed."""
    return F.when(F.length(prompt) > 0, F.replace(generated, prompt, F.lit(""))).otherwise(generated)
