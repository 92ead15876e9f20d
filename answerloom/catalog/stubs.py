"""Stand-in graders and generators for checks; they judge nothing.

All of them depend on nothing but their arguments, so results can be compared.
"""


def _overlap(question, answer):
    return len(set(question.split(" ")) & set(answer.split(" ")))


def row_predictor():
    """Class by number of words shared with the question; long questions fail."""

    def predict(questions, answers, references):
        if any(len(q) > 400 for q in questions):
            raise ValueError("question too long")
        return [min(2, _overlap(q, a)) for q, a in zip(questions, answers)]

    return predict


def question_predictor():
    """Same rule against the group's question; three or more answers get one label too few."""

    def predict(question, answers, reference):
        labels = [min(2, _overlap(question, a)) for a in answers]
        return labels[:-1] if len(labels) > 2 else labels

    return predict


def single_generator():
    """Label and question; long questions fail."""

    def generate(label, question, reference):
        if len(question) > 400:
            raise ValueError("question too long")
        return f"{label}/{'-' if reference is None else len(reference)}/{question}"

    return generate


def question_generator():
    """The question's lines; questions with too few lines give short replies."""

    def generate(label, question, reference, count):
        return [f"{label}: {line}" for line in question.split("\n")]

    return generate


def batch_generator():
    def generate(label, questions, references, count):
        return [f"{label} {i} {q}" for q in questions for i in range(count)]

    return generate
