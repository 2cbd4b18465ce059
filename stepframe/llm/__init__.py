"""Training-data operators at corpus scale; nothing else in stepframe imports this package."""
