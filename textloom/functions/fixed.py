"""Word lists, scales and prompt formats that results depend on.

They are kept together, as plain text, and are used nowhere else but through the
functions of ``textloom.functions.prompts``.
"""

# Predicates, in the order of the scenario blocks.
PREDICATES = ["cold", "loud", "messy", "long"]

# Modifiers, in design order.
MODIFIERS = ["slightly", "kind of", "quite", "very", "extremely"]

# The five options of each predicate, A to E.
SCALES = {
    "cold": ["Much colder", "Somewhat colder", "About the same", "Somewhat warmer", "Much warmer"],
    "loud": ["Much louder", "Somewhat louder", "About the same", "Somewhat quieter", "Much quieter"],
    "messy": ["Much messier", "Somewhat messier", "About the same", "Somewhat tidier", "Much tidier"],
    "long": ["Much longer", "Somewhat longer", "About the same", "Somewhat shorter", "Much shorter"],
}

# The slot in scenario templates.
SLOT = "[modifier]"

# Politeness options, A to E.
POLITENESS = ["Much less polite", "Somewhat less polite", "About the same politeness", "Somewhat more polite", "Much more polite"]

# Prompt formats. {name} marks what is filled in.
SINGLE_HEAD = "\nPlease read this scenario and answer the question afterwards:\nScenario:\n{plain}\n\nQuestion: "
CHOICE_QUESTION = 'If {speaker} was more polite and had said "{quote}" (adding "{modifier}") instead, does this mean they are actually feeling:\n{options}'
RATING_QUESTION = (
    'If {speaker} was more polite and had said "{quote}" (adding "{modifier}") instead. How {predicate} do they think it is? '
    "Choose a number on a scale from {low} (1) to {high} (7).\n"
)
POLITENESS_QUESTION = 'If {speaker} had said "{quote}" (adding "{modifier}"),would it be:\n{options}'
SINGLE_CHOICE_TAIL = '\nPlease output your answer as a json format like this:\n{"scenario_answer": "<your_choice>"}\n\nDo not output anything else.\n    '
SINGLE_NUMBER_TAIL = '\nPlease output your answer as a json format like this:\n{"scenario_answer": "<your_number>"}\n\nDo not output anything else.\n    '
PAIR_HEAD = "\nPlease read these two scenarios:\nScenario 1:\n{first}\n\nScenario 2:\n{second}\n\n"
PAIR_CHOICE_QUESTION = 'If {speaker} had said "{quote}" (adding "{modifier}"), does this mean they are actually feeling:\n{options}'
PAIR_JSON = '{"scenario_1_answer": "<your_choice_for_scenario_1>", "scenario_2_answer": "<your_choice_for_scenario_2>"}\n\nDo not output anything else.\n    '
PAIR_CHOICE_TAIL = "\nPlease only output your answer as a json format like this:\n"
PAIR_POLITENESS_TAIL = "\nPlease provide your choice for each of the two scenarios. Output your answer as a json format like this:\n"
ALL_RATING_HEAD = (
    "Please rate the following scenarios on a scale from not cold/loud/messy/long at all (0) to as cold/loud/messy/long as possible (100)."
)
ALL_RATING_TAIL = (
    "Output your response as list in this exact format:\n"
    "[ <answer_to_scenario1>, <answer_to_scenario2>, <answer_to_scenario3>, <answer_to_scenario4>,....... ]\n\n"
    "for example:\n[ 11, 74, 32, 6, 90, ....]\n\nOutput nothing but the list."
)
CONTAINS_HEAD = (
    "For each of these sentences, output a list of True/False. True, if the sentence contains a modifier, and false if it does not. "
    "Output your answer in the form of a list (e.g. [True, False ... ]). Output nothing else:\n"
)
CONTAINS_TAIL_HEAD = (
    "For each of these sentences, output a list of True/False values corresponding to whether it contains a modifier in the form of a list (e.g. [True, False ... ]):\n"
)
LABEL_HEAD = (
    "For each of these sentences, output whether the sentence contains a downtoner. Output True, if the sentence contains a downtoner, and false if it does not. "
    "If true, also output the modifier i the sentnece. Output your answer in the format of a json file, for example,\n"
    '{"sentence_1": (False, "NA"), "sentence_2":(True, "a bit"), "sentence_3":(True,"really").....}\nHere are the sentences:\n\n'
)
LABEL_TAIL = '\n\nMake sure the second argument (e.g. "only" or "NA") is in double quotes'
POLITE_HEAD = "For each of these sentences, output how polite the sentence is on a scale from 0 to 10:\n"
CONTEXT_PROMPT = (
    'Analyze "{phrase}" in this Wikipedia discussion:\n\nPAGE: {title}\n\nCONTEXT BEFORE:\n{before}\n\n'
    'TARGET SENTENCE (contains "{phrase}"):\n{target}\n\nCONTEXT AFTER:\n{after}\n\nAnswer the following question:\n'
    "- In one sentence, what is being discussed in this part of the talk page?\n"
    '- Does the writer use "{phrase}" as a way to be polite? Provide a one sentence explanation, and output a number from 1 '
    "(not used for politeness at all) to 5 (used only for the sake of politeness).\n"
)

# Request keys and batch sizes.
CHUNK = 30
ATTEMPTS = 3
JUDGES = 3

# Job states in which a batch job has ended.
ENDED_STATES = ["JOB_STATE_SUCCEEDED", "JOB_STATE_FAILED", "JOB_STATE_CANCELLED", "JOB_STATE_EXPIRED"]
