"""Questions, prompts, names and chat messages, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of questions and prompts.
SHORT_ANSWER = "Answer the question using a single word or phrase."
OBJECT_NAMES = "Answer only with object names."
OPTION_LETTER = "Answer with only the option letter (A, B, C, or D)."
CHOICE_QUESTION = "Which object is present in the image? (A) %s (B) %s (C) %s (D) %s. Answer with only the option letter (A, B, C, or D)."
FOCUS = "Focus on the visual aspects of the image, including colors, shapes, composition, and any notable visual themes. Provide a detailed visual description of the image to answer the following question. Then based on your previous description, please delve deeper into the visual details of the image and include any subtle details or elements that were not covered in your initial description to answer the following question. "
SOLVE = "Solve the problem based on the analysis above. "
TASK_SUFFIX = {"txt_oe": SHORT_ANSWER, "obj_oe": OBJECT_NAMES, "obj_mc": OPTION_LETTER}
UNANSWERABLE = "\nWhen the provided information is insufficient, respond with 'Unanswerable'.\nAnswer the question using a single word or phrase."
LABEL_TEMPLATES = ["a photo of a {}.", "an image of a {}.", "a close-up photo of a {}.", "a cropped photo of a {}.", "a low angle photo of a {}.", "a high angle photo of a {}."]
# The public ensemble of eighty templates for labels of images, in its order, and the two single ones.
ENSEMBLE = [
    "a bad photo of a {}.", "a photo of many {}.", "a sculpture of a {}.", "a photo of the hard to see {}.", "a low resolution photo of the {}.", "a rendering of a {}.", "graffiti of a {}.",
    "a bad photo of the {}.", "a cropped photo of the {}.", "a tattoo of a {}.", "the embroidered {}.", "a photo of a hard to see {}.", "a bright photo of a {}.", "a photo of a clean {}.",
    "a photo of a dirty {}.", "a dark photo of the {}.", "a drawing of a {}.", "a photo of my {}.", "the plastic {}.", "a photo of the cool {}.", "a close-up photo of a {}.",
    "a black and white photo of the {}.", "a painting of the {}.", "a painting of a {}.", "a pixelated photo of the {}.", "a sculpture of the {}.", "a bright photo of the {}.",
    "a cropped photo of a {}.", "a plastic {}.", "a photo of the dirty {}.", "a jpeg corrupted photo of a {}.", "a blurry photo of the {}.", "a photo of the {}.", "a good photo of the {}.",
    "a rendering of the {}.", "a {} in a video game.", "a photo of one {}.", "a doodle of a {}.", "a close-up photo of the {}.", "a photo of a {}.", "the origami {}.", "the {} in a video game.",
    "a sketch of a {}.", "a doodle of the {}.", "a origami {}.", "a low resolution photo of a {}.", "the toy {}.", "a rendition of the {}.", "a photo of the clean {}.", "a photo of a large {}.",
    "a rendition of a {}.", "a photo of a nice {}.", "a photo of a weird {}.", "a blurry photo of a {}.", "a cartoon {}.", "art of a {}.", "a sketch of the {}.", "a embroidered {}.",
    "a pixelated photo of a {}.", "itap of the {}.", "a jpeg corrupted photo of the {}.", "a good photo of a {}.", "a plushie {}.", "a photo of the nice {}.", "a photo of the small {}.",
    "a photo of the weird {}.", "the cartoon {}.", "art of the {}.", "a drawing of the {}.", "a photo of the large {}.", "a black and white photo of a {}.", "the plushie {}.", "a dark photo of a {}.",
    "itap of a {}.", "graffiti of the {}.", "a toy {}.", "itap of my {}.", "a photo of a cool {}.", "a photo of a small {}.", "a tattoo of the {}.",
]
TEMPLATE_SETS = {"openai_imagenet_template": ENSEMBLE, "none": ["{}."], "photo": ["a photo of a {}."]}


def with_suffix(question: Column) -> Column:
    """The question with the short-answer request, whether or not it has it."""
    return F.concat(question, F.lit(" " + SHORT_ANSWER))


def choice_question(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The multiple-choice question."""
    return F.format_string(CHOICE_QUESTION, a, b, c, d)


def attack_word(level: Column, answer: Column, choices: dict[str, Column]) -> Column:
    """Empty for ``clean``, the answer for ``correct``, else the level's choice; an unknown level is an error."""
    out = F.when(level == "clean", F.lit("")).when(level == "correct", answer)
    for name, word in choices.items():
        out = out.when(level == name, word)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown level "), level)))


def turns(task: Column, question: Column, strategy: Column) -> Column:
    """The user turns of a prompt strategy."""
    short = F.lit(None).cast("string")
    for name, suffix in TASK_SUFFIX.items():
        short = F.when(task == name, F.regexp_replace(F.replace(question, F.lit(suffix), F.lit("")), r"^\s+|\s+$", "")).otherwise(short)
    short = F.coalesce(short, F.when(question.isNotNull(), F.raise_error(F.concat(F.lit("unknown task "), task)).cast("string")))
    return (
        F.when(strategy == "1phase-basic", F.array(question))
        .when(strategy == "1phase-focus", F.array(F.concat(F.lit(FOCUS), question)))
        .when(strategy == "2phase-focus", F.array(F.concat(F.lit(FOCUS), short), F.concat(F.lit(SOLVE), question)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown strategy "), strategy)).cast("array<string>"))
    )


def task_of_name(name: Column) -> Column:
    """The task that a dataset's path names (P08); null where it names none."""
    parts = F.filter(F.split(name, "/"), lambda p: p != "")
    base, group = F.coalesce(F.try_element_at(parts, F.lit(-1)), name), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    mc, oe = F.startswith(base, F.lit("mc_")) | F.contains(base, F.lit("mcq")), F.startswith(base, F.lit("oe_")) | F.contains(base, F.lit("open_ended"))
    obj, loose_mc, loose_oe = F.contains(F.concat(F.lit("/"), name), F.lit("/obj_")), base.rlike("mc_|mcq"), base.rlike("oe_|open_ended")
    return (
        F.when(F.startswith(group, F.lit("txt_")), "txt_oe")
        .when(F.startswith(group, F.lit("obj_")) & mc, "obj_mc")
        .when(F.startswith(group, F.lit("obj_")) & oe, "obj_oe")
        .when(F.contains(F.concat(F.lit("/"), name), F.lit("/txt_")) | F.contains(name, F.lit("open_ended")), "txt_oe")
        .when(obj & loose_mc, "obj_mc")
        .when(obj & loose_oe, "obj_oe")
    )


def split_subset(name: Column) -> Column:
    """(split, subset) of a dataset's path: the last part cut at its first ``__``, else the last two parts."""
    parts = F.split(F.regexp_replace(name, "^/+|/+$", ""), "/")
    last = F.element_at(parts, -1)
    cut = F.split(last, "__", 2)
    both = F.size(cut) > 1
    return F.struct(F.when(both, cut[0]).otherwise(F.try_element_at(parts, F.lit(-2))).alias("split"), F.when(both, F.try_element_at(cut, F.lit(2))).when(F.size(parts) > 1, last).alias("subset"))


def record_kind(split: Column, subset: Column) -> Column:
    """Which record a training example becomes: ``obj_mcq``, ``obj_open`` or ``txt_open``; open-ended where unknown."""
    s, t = F.lower(split), F.lower(subset)
    mc, oe = t.rlike("^(mcq|mc_)|^mc$"), F.contains(t, F.lit("open")) | t.rlike("(?:^|[_-])oe(?:$|[_-])")
    return F.when(F.startswith(s, F.lit("obj")) & mc, "obj_mcq").when(F.startswith(s, F.lit("obj")) & oe, "obj_open").when(s.rlike("^(txt|text)") & oe, "txt_open").otherwise("obj_open")


def part(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.alias("text"))


def message(role: Column | str, *parts: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), F.array(*parts).alias("content"))


def chat(questions: Column, answers: Column, image: Column, eos: Column | str = "") -> Column:
    """User and assistant messages in turn; the image is a part of the first alone (P10)."""
    end = F.lit(eos) if isinstance(eos, str) else eos

    def pair(q: Column, i: Column) -> Column:
        text = part("text", q)
        asked = F.when(i == 0, F.array(part("image", image), text)).otherwise(F.array(text))
        return F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")), message("assistant", part("text", F.concat(F.coalesce(F.get(answers, i), F.lit("")), end))))

    return F.flatten(F.transform(questions, pair))


def instruct_messages(turns: Column, image: Column, eos: Column | str = "") -> Column:
    """Turns (from, value) as messages: ``human`` asks, ``gpt`` answers, any other is an error; the image goes to the first turn and its marker from the text."""
    end = F.lit(eos) if isinstance(eos, str) else eos

    def one(t: Column, i: Column) -> Column:
        text = F.regexp_replace(F.replace(t["value"], F.lit("<image>"), F.lit("")), r"^\s+|\s+$", "")
        role = F.when(t["from"] == "human", "user").when(t["from"] == "gpt", "assistant").otherwise(F.raise_error(F.concat(F.lit("unknown role "), t["from"])))
        said = F.when(t["from"] == "gpt", F.concat(text, end)).otherwise(text)
        return F.struct(role.alias("role"), F.when((i == 0) & image.isNotNull(), F.array(part("image", image), part("text", said))).otherwise(F.array(part("text", said))).alias("content"))

    return F.transform(turns, one)


def lettered(choices: Column) -> Column:
    """Choices on lines of their own, each behind its letter."""
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.chr(i + 65), F.lit(". "), c)), "\n")


def vqa_query(dataset: Column, model: Column, hint: Column, question: Column, choices: Column) -> Column:
    """The user's text for four question-answering sets, as a model family wants it."""
    d, qwen, context = F.lower(dataset), F.contains(F.lower(model), F.lit("qwen")), F.coalesce(hint, F.lit(""))
    return (
        F.when(F.contains(d, F.lit("scienceqa")) & qwen, F.concat(F.lit("Context: "), F.when(context == "", "N/A").otherwise(context), F.lit("\nQuestion: "), question, F.lit("\nOptions: "), lettered(choices), F.lit("\nAnswer:")))
        .when(F.contains(d, F.lit("scienceqa")), F.concat(context, question, F.lit("\n"), lettered(choices), F.lit("\nAnswer with the option's letter from the given choices directly.")))
        .when(F.contains(d, F.lit("ok-vqa")), F.concat(question, F.lit(UNANSWERABLE)))
        .when(F.contains(d, F.lit("vizwiz")), F.concat(F.upper(F.substring(question, 1, 1)), F.lower(F.substring(question, 2, 1 << 30)), F.lit(UNANSWERABLE)))
        .when(F.contains(d, F.lit("textvqa")), F.concat(question, F.when(qwen, F.lit(" Answer:")).otherwise(F.lit("\nAnswer the question with a single word."))))
    )


def first_text(*candidates: Column) -> Column:
    """The first that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def artifact_name(image_id: Column, question_id: Column, *parts: Column, extension: str = "jpg") -> Column:
    """The file of an image's variant (P20)."""
    return F.concat(F.regexp_replace(F.concat_ws("_", image_id, question_id, *parts), r"[^\w.-]+", "-"), F.lit(f".{extension}"))


def model_name(path: Column) -> Column:
    """The last part of a path; a checkpoint is named with its parent."""
    flat = F.regexp_replace(path, "/+$", "")
    last, parent = F.substring_index(flat, "/", -1), F.element_at(F.split(flat, "/"), F.when(F.size(F.split(flat, "/")) > 1, -2).otherwise(-1))
    return F.when(F.startswith(last, F.lit("checkpoint-")), F.concat(parent, F.lit("_"), last)).otherwise(last)


def label_prompts(label: Column, templates: list[str] | None = None) -> Column:
    """A label in each template, underscores as spaces (N23). ``TEMPLATE_SETS`` has the named sets of templates."""
    shown = F.replace(label, F.lit("_"), F.lit(" "))
    return F.array(*[F.concat(F.lit(t.split("{}")[0]), shown, F.lit(t.split("{}")[1])) for t in templates or LABEL_TEMPLATES])


def few_shot(instructions: str, examples: list[tuple[str, str]], question: Column, answer: Column) -> Column:
    """A prompt of fixed instructions and examples before the question at hand."""
    shown = "".join(f"\n{q}\n{a}\n" for q, a in examples)
    return F.concat(F.lit(instructions + shown + "\n"), question, F.lit("\n"), answer)
