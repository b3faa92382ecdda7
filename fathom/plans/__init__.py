"""Named query plans over tables, with the SQL that states what they compute."""
