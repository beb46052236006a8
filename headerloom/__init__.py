"""Header forensics over tables of e-mail messages, on Spark."""
