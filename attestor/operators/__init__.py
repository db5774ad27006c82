"""Table operators: validation, grounding, rules, replay, tool calls, analytics and scoring."""
