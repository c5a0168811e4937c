from lodestone.plans.service import main

main()
