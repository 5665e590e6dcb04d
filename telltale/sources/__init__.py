"""Reading texts and tables; deciding what each file is."""
