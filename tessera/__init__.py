"""An engine of DataFrame operators for hybrid document retrieval and the text around it."""
