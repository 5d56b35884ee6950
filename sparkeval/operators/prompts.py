"""Zero-shot and few-shot prompts from one template for each task and language."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import column, truncate

QUERY_TYPES = ("zero-shot", "zero-shot-si", "few-shot", "few-shot-si")


@dataclass(frozen=True)
class Template:
    task: str
    action: str
    lead_in: str
    closing: str
    label: str
    marker: str
    system: str = "You write careful, fluent Sinhala."
    cut: int | None = None  # code points of an example's input


#: Our own wording, by task and language.
TEMPLATES: dict[tuple[str, str], Template] = {
    ("simplification", "en"): Template("You know Sinhala well. Rewrite the sentence (S) in simpler Sinhala: keep its main idea, split long sentences, and use common words.", "Write only the simple version after 'Simplified text:'.", "Some examples:", "Now make this one simpler:", "S", "Simplified text:"),
    ("simplification", "si"): Template("ඔබ සිංහල භාෂාව හොඳින් දනියි. පහත වාක්‍යය (S) සරල සිංහලෙන් නැවත ලියන්න.", "'Simplified text:' යන්නෙන් පසු සරල වාක්‍යය පමණක් ලියන්න.", "උදාහරණ:", "මෙම වාක්‍යය සරල කරන්න:", "S", "Simplified text:"),
    ("headline", "en"): Template("You edit a Sinhala newspaper. Write a headline in Sinhala for the news below.", "Write only the headline after 'Headline:'.", "Some examples:", "Now give this report its headline:", "News Content", "Headline:", cut=500),
    ("headline", "si"): Template("ඔබ සිංහල පුවත්පතක කතුවරයෙකි. පහත පුවතට සිරස්තලයක් ලියන්න.", "'Headline:' යන්නෙන් පසු සිරස්තලය පමණක් ලියන්න.", "උදාහරණ:", "මෙම පුවතට සිරස්තලයක් ලියන්න:", "News Content", "Headline:", cut=500),
    ("summarisation", "en"): Template("You know Sinhala well. Sum up the text below in one or two Sinhala sentences.", "Write only the summary after 'Summary:'.", "Some examples:", "Sum up this text:", "Text", "Summary:", cut=500),
    ("summarisation", "si"): Template("ඔබ සිංහල භාෂාව හොඳින් දනියි. පහත පෙළ කෙටියෙන් සාරාංශ කරන්න.", "'Summary:' යන්නෙන් පසු සාරාංශය පමණක් ලියන්න.", "උදාහරණ:", "මෙම පෙළ සාරාංශ කරන්න:", "Text", "Summary:", cut=500),
    **{
        (f"{code}_si", lang): Template(task, action, lead, close, letter, "Translation:")
        for code, letter, name, si in (("en", "E", "English", "ඉංග්‍රීසි"), ("ta", "T", "Tamil", "දෙමළ"), ("pi", "P", "Pali", "පාලි"))
        for lang, task, action, lead, close in (
            ("en", f"You translate from {name} to Sinhala. Translate the sentence ({letter}) faithfully.", "Write only the translation after 'Translation:'.", "Some examples:", "Now put this one into Sinhala:"),
            ("si", f"ඔබ {si} භාෂාවෙන් සිංහලට පරිවර්තනය කරයි. පහත වාක්‍යය ({letter}) පරිවර්තනය කරන්න.", "'Translation:' යන්නෙන් පසු පරිවර්තනය පමණක් ලියන්න.", "උදාහරණ:", "දැන් මෙය සිංහලෙන් ලියන්න:"),
        )
    },
}


def template(task: str, query_type: str) -> Template:
    if query_type not in QUERY_TYPES:
        raise ValueError(f"unknown query type {query_type!r}; known: {', '.join(QUERY_TYPES)}")
    return TEMPLATES[task, "si" if query_type.endswith("-si") else "en"]


def zero_shot(t: Template, source: Column | str) -> Column:
    return F.concat(F.lit(f"{t.task} {t.action} {t.label}: "), column(source))


def few_shot(t: Template, source: Column | str, examples: Column | str) -> Column:
    """Task, action, numbered examples (array of input, output structs), and the input."""

    def block(e: Column, i: Column) -> Column:
        given = truncate(e["input"], t.cut) if t.cut else e["input"]
        return F.concat(F.lit("\nExample "), (i + 1).cast("string"), F.lit(f":\n{t.label}: "), given, F.lit(f"\n{t.marker} "), e["output"], F.lit("\n"))

    shown = F.array_join(F.transform(column(examples), block), "")
    return F.concat(F.lit(f"{t.task}\n\n{t.action}\n\n{t.lead_in}"), shown, F.lit(f"\n\n{t.closing}\n{t.label}: "), column(source))


def prompt(task: str, query_type: str, source: Column | str, examples: Column | str | None = None) -> Column:
    t = template(task, query_type)
    return few_shot(t, source, examples) if query_type.startswith("few") else zero_shot(t, source)


def chat(content: Column, system: str | None = None) -> Column:
    """A prompt as an array of messages (role, content), after a system turn if there is one."""
    turns = [("system", F.lit(system))] * (system is not None) + [("user", content)]
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns])
